"""The sixteen reports, composed from the operators (no logic of their own
beyond choosing columns and parameters).

Procedure bodies are not part of the reference, so the semantics of each
report are our definition from its parameters and result columns; see
ones, which return a ``Page`` (the clamped variant runs its count first).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regsight import schemas
from regsight.functions import normalise as N
from regsight.functions import scalar as P
from regsight.operators import aggregate as A
from regsight.operators import changes as CH
from regsight.operators import filters as FL
from regsight.operators import joins as J
from regsight.operators import paging as W
from regsight.operators import project as PR
from regsight.session import cut_lineage
from regsight.sources import layout as LY
from regsight.sources import standin as V
from regsight.sources.tables import instant_text

# Fixed values from the reference configuration: packaging types and
# materials included, and the size code of large organisations.
DEFAULT_PACKAGING_TYPES = "HH,NH,PB,HDC,NDC"
DEFAULT_PACKAGING_MATERIALS = "AL,FC,GL,PC,PL,ST,WD"
LARGE_ORGANISATION = "L"
# Our period descriptions for the extract (half years and their quarter forms).
HALF_DESCRIPTIONS = (("H1", "January to June"), ("H2", "July to December"),
                     ("P1", "January to June"), ("P4", "July to December"))

SUBMITTED_TEXT = "yyyy-MM-dd'T'HH:mm:ss"
#: Our definition: a regulator decides this long after the submission.
DECISION_DELAY = dt.timedelta(days=14)
HISTORY_GROUP = ["organisation_id", "submission_year"]
HISTORY_ORDER = ["submitted_at", "submission_id"]


def _years_of_periods(periods: str | None):
    """Years named by a period list (a scan hint); None if any item has no year."""
    items = FL.csv_items(periods)
    if not items or not all(p.split("-")[0].isdigit() for p in items):
        return None
    return sorted({int(p.split("-")[0]) for p in items})


def _years_of_csv(csv: str | None):
    items = FL.csv_items(csv)
    return sorted({int(x) for x in items}) if items else None


def _today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def submitter_type(org_type_col: str = "organisation_type"):
    """Submitter type of a POM line from its organisation's type (our definition)."""
    return (F.when(F.col(org_type_col) == "CS", F.lit("ComplianceScheme"))
            .otherwise(F.lit("DirectRegistrant")))


def submitted_after(approved_after) -> str | None:
    """The submission instant that belongs to a decision instant (pushable to the scan)."""
    if approved_after is None:
        return None
    decided = dt.datetime.fromisoformat(instant_text(approved_after))
    return instant_text(decided - DECISION_DELAY)


def with_history(subs: DataFrame, ids=None, few: bool = False) -> DataFrame:
    """W2 over submissions: resubmission flag and previous rejection comments.

    With ``ids`` (a submission id, or a frame of them) the result keeps only
    those submissions, and the history is computed only over the
    (organisation, year) groups they belong to, null ones included: exact,
    since W2 never looks outside a group. ``few`` says that a frame of ids is
    bounded, so their groups can be broadcast.
    """
    if ids is not None:
        wanted = FL.filter_key(subs, "submission_id", ids)
        groups = W.renamed(wanted.select(*HISTORY_GROUP).distinct(), HISTORY_GROUP)
        if few or not isinstance(ids, DataFrame):
            groups = F.broadcast(groups)
        subs = subs.join(groups, W.same_as(subs, HISTORY_GROUP), "left_semi")
    out = W.resubmission_history(subs, HISTORY_GROUP, HISTORY_ORDER, "status", "comments")
    return FL.filter_key(out, "submission_id", ids) if ids is not None else out


def decisions_from_events(spark: SparkSession, sf_dir: str, with_required: bool = True) -> DataFrame:
    """Pending regulator decisions as the event store carries them (J1's delta)."""
    ev = V.submission_events(spark, sf_dir, decided_only=True).filter(F.col("decision").isNotNull())
    cols = ["file_id", "decision", "comments", "load_ts", "submission_event_id"]
    if with_required:
        cols.append("is_resubmission_required")
    return ev.select(*cols)


# Q16 -----------------------------------------------------------------------
def last_sync_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16: one row, the latest load time of the event store (A1)."""
    return A.max_sync_time(V.submission_events(spark, sf_dir), "load_ts", "last_sync_time")


# Q3 ------------------------------------------------------------------------
def _approved_lines(spark, sf_dir, subs: DataFrame, types, materials,
                    org_size=None) -> DataFrame:
    orgs = V.organisations(spark, sf_dir, size=org_size).select(
        "organisation_id", "organisation_type", "organisation_size", "num_days_obligated")
    orgs = FL.filter_optional_eq(orgs, "organisation_size", org_size)
    enriched = J.enrich_submissions(subs, orgs)
    lines = V.pom_lines(spark, sf_dir, enriched, subs_bound=subs)
    lines = FL.filter_csv(lines, "packaging_type", types)
    lines = FL.filter_csv(lines, "packaging_material", materials)
    return lines.select(
        "submission_period", "packaging_material", "organisation_id",
        F.col("person_id").alias("submitter_id"), submitter_type().alias("submitter_type"),
        "packaging_material_weight",
        F.col("num_days_obligated").alias("number_of_days_obligated"))


def _approved_lines_stored(spark, sf_dir, lines: DataFrame, types, materials,
                           org_size=None) -> DataFrame:
    """As ``_approved_lines`` over POM lines read from the stored layout."""
    lines = lines.filter((F.col("status") == V.STATUS_ACCEPTED)
                         & (F.col("submission_type") == "Producer"))
    orgs = V.organisations(spark, sf_dir, size=org_size).select(
        "organisation_id", "organisation_type", "organisation_size", "num_days_obligated")
    orgs = FL.filter_optional_eq(orgs, "organisation_size", org_size)
    lines = FL.filter_csv(J.enrich_submissions(lines, orgs), "packaging_type", types)
    return FL.filter_csv(lines, "packaging_material", materials).select(
        "submission_period", "packaging_material", "organisation_id",
        F.col("person_id").alias("submitter_id"), submitter_type().alias("submitter_type"),
        "packaging_material_weight", F.col("num_days_obligated").alias("number_of_days_obligated"))


def approved_submissions(spark: SparkSession, sf_dir: str, approved_after=None,
                         periods: str | None = None, types: str = DEFAULT_PACKAGING_TYPES,
                         materials: str = DEFAULT_PACKAGING_MATERIALS,
                         org_size: str | None = LARGE_ORGANISATION,
                         as_of: dt.date | None = None, warehouse: dict | None = None) -> DataFrame:
    """Q3: approved weights of large organisations for the reported periods.

    Without ``periods`` the periods of the reported year (P5) of ``as_of``
    (default: today, UTC) are used. ``approved_after`` is compared with the
    decision instant. With ``warehouse`` the POM lines are
    read from the stored layout's year partitions.
    """
    if periods is None:
        periods = P.periods_for_year(P.derive_period_year(as_of or _today()))
    approved_after = submitted_after(approved_after)
    if warehouse is not None:
        lines = LY.read_stored(spark, warehouse["pom_lines"], years=_years_of_periods(periods))
        lines = FL.filter_csv(lines, "submission_period", periods)
        lines = FL.filter_approved_after(lines, "submitted_at", approved_after)
        return A.approved_weights(_approved_lines_stored(spark, sf_dir, lines, types, materials,
                                                         org_size))
    subs = V.submissions(spark, sf_dir, years=_years_of_periods(periods), kind="Producer",
                         statuses=[V.STATUS_ACCEPTED], submitted_between=(approved_after, None))
    subs = subs.filter(F.col("status") == V.STATUS_ACCEPTED)
    subs = FL.filter_csv(subs, "submission_period", periods)
    subs = FL.filter_approved_after(subs, "submitted_at", approved_after)
    lines = _approved_lines(spark, sf_dir, subs, types, materials, org_size)
    return A.approved_weights(lines)


# Q4 ------------------------------------------------------------------------
def approved_submissions_by_year(spark: SparkSession, sf_dir: str, period_year: int | None = None,
                                 types: str = DEFAULT_PACKAGING_TYPES,
                                 materials: str = DEFAULT_PACKAGING_MATERIALS,
                                 as_of: dt.date | None = None,
                                 warehouse: dict | None = None) -> DataFrame:
    """Q4: approved weights for one year (no date or size filter).

    With ``warehouse`` (paths from ``layout.write_warehouse``) the POM lines
    are read from the year's partition instead of being derived.
    """
    year = int(period_year) if period_year is not None else P.derive_period_year(as_of or _today())
    if warehouse is not None:
        stored = LY.read_stored(spark, warehouse["pom_lines"], years=[year])
        return A.approved_weights_by_year(
            _approved_lines_stored(spark, sf_dir, stored, types, materials))
    subs = V.submissions(spark, sf_dir, years=[year], kind="Producer",
                         statuses=[V.STATUS_ACCEPTED])
    subs = subs.filter((F.col("status") == V.STATUS_ACCEPTED) & (F.col("submission_year") == year))
    lines = _approved_lines(spark, sf_dir, subs, types, materials)
    return A.approved_weights_by_year(lines)


INVALID_DATETIME = N.INVALID_DATETIME_MESSAGE


def parse_request_datetime(text: str, spark: SparkSession | None = None) -> dt.datetime:
    """N9 for a request parameter: parse a date text as UTC or reject it, by the column rule."""
    spark = spark or SparkSession.getActiveSession()
    micros = spark.range(1).select(F.unix_micros(N.parse_utc_date(F.lit(str(text))))).first()[0]
    if micros is None:
        raise ValueError(INVALID_DATETIME)
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)


def approved_submissions_report(spark: SparkSession, sf_dir: str, approved_after: str,
                                as_of: dt.date, by_year: bool = True) -> DataFrame:
    """The approved-weights question as asked: the approved-after text is
    validated first (and rejected with a message), the reported year comes
    from the as-of date (P5), and the by-year variant (default on) ignores
    the approved-after instant, as the reference's configuration does."""
    after = parse_request_datetime(approved_after, spark)
    year = P.derive_period_year(as_of)
    if by_year:
        return approved_submissions_by_year(spark, sf_dir, period_year=year)
    return approved_submissions(spark, sf_dir, approved_after=instant_text(after),
                                periods=P.periods_for_year(year), org_size=LARGE_ORGANISATION)


# Pages ---------------------------------------------------------------------
def _fetch_page(page: W.Page, order_cols: list, fetch, schema) -> W.Page:
    """The full rows of a page whose keys have been chosen.

    ``fetch(keys, few)`` computes the rows of those submissions, so windows
    and wide joins see the page's groups only. The keys (a page of them) are
    written once; they are broadcast up to ``MAX_BROADCAST_PAGE``.
    """
    chosen = cut_lineage(page.items)
    few = page.page_size <= W.MAX_BROADCAST_PAGE
    keys = chosen.drop("total_items")
    rows = N.align_schema(fetch(F.broadcast(keys) if few else keys, few), schema)
    total = chosen.select(F.max("total_items")).scalar()
    items = rows.withColumn("total_items", total).orderBy(*order_cols)
    return W.Page(items, page.current_page, page.page_size, page.known_total)


# Q1 / Q2 -------------------------------------------------------------------
EVENT_ORDER = ["load_ts", "submission_event_id"]


def _apply_decisions(spark, sf_dir, subs, decisions, with_required, decision_order=None, files=None):
    """J1 with the delta from the event store (default), a DataFrame, or JSON text.

    ``files`` (a frame of file ids) limits a stored delta to the entries that can match.

    A DataFrame delta needs ``file_id``, the overlaid columns and the columns
    of ``decision_order`` (default: load time, event id), which decide the
    last entry per file.
    """
    cols = ["decision", "comments"] + (["is_resubmission_required"] if with_required else [])
    if decisions is None:
        decisions = decisions_from_events(spark, sf_dir, with_required)
        decision_order = EVENT_ORDER
    if isinstance(decisions, str):
        schema = PR.POM_DECISION_SCHEMA if with_required else PR.REGISTRATION_DECISION_SCHEMA
        text = spark.createDataFrame([(decisions,)], "delta string")
        decoded = PR.decode_decisions(text, "delta", schema)
        # position in the array orders the entries: the last one per file wins
        decoded = decoded.select(*[F.col(c).alias(_snake(c)) for c in decoded.columns]) \
            .withColumn("_pos", F.monotonically_increasing_id())
        # stored ids are canonical; a request may write them otherwise
        decoded = decoded.withColumn("file_id", F.coalesce(N.try_norm_guid("file_id"), F.col("file_id")))
        return J.overlay_decisions(subs, decoded, "file_id", cols, ["_pos"])
    order = list(decision_order or EVENT_ORDER)
    missing = [c for c in ["file_id", *cols, *order] if c not in decisions.columns]
    if missing:
        raise ValueError(f"decisions frame lacks columns {missing}")
    if files is not None:
        decisions = FL.filter_key(decisions, "file_id", files)
    return J.overlay_decisions(subs, decisions, "file_id", cols, order)


def _snake(name: str) -> str:
    return "".join(("_" + ch.lower()) if ch.isupper() and i else ch.lower()
                   for i, ch in enumerate(name))


def _visible_organisations(spark, sf_dir, user_id) -> DataFrame:
    """Organisations a regulator user sees: those of the user's nation; all without a user.

    The procedure's rule is not part of the reference; this one is ours. An
    unknown user sees none.
    """
    orgs = V.organisations(spark, sf_dir)
    if user_id is None:
        return orgs
    nation = FL.filter_key(V.regulator_nations(spark, sf_dir), "user_id", user_id).select("nation_id")
    return orgs.join(nation, "nation_id", "left_semi").select(*orgs.columns)


def _list_filters(df, organisation_name, organisation_reference, statuses, organisation_type,
                  years, periods):
    df = FL.filter_name(df, "organisation_name", organisation_name,
                        "organisation_reference_text", organisation_reference)
    df = FL.filter_csv(df, "decision", statuses)
    df = FL.filter_optional_eq(df, "organisation_type", organisation_type)
    if years:
        df = FL.filter_csv(df, "submission_year_text", years)
    # quirk kept: the request's periods feed the *actual* period parameter
    df = FL.filter_csv(df, "actual_submission_period", periods)
    return df


def _summary_page(spark, sf_dir, kind, schema, date_col, columns, decisions, decision_order, user_id,
                  page_number, page_size, statuses, years, **filters) -> W.Page:
    """Q1/Q2: the page's keys first, then its rows with history, decisions and persons.

    No filter of the two lists looks at the history, and the pending decisions
    matter to the choice only where statuses are asked for.
    """
    with_required = kind == "Producer"
    subs = V.submissions(spark, sf_dir, years=_years_of_csv(years), kind=kind)
    subs = subs.withColumn("decision", F.col("status"))
    if with_required:
        subs = subs.withColumn("is_resubmission_required", F.lit(None).cast("boolean"))
    orgs = _visible_organisations(spark, sf_dir, user_id)

    def overlaid(df, files=None):
        return _apply_decisions(spark, sf_dir, df, decisions, with_required, decision_order, files)

    def shared(df):
        return df.select(
            "*",
            F.col("organisation_reference").alias("organisation_reference_text"),
            F.col("submission_year").cast("string").alias("submission_year_text"),
            F.col("submission_period").alias("actual_submission_period"),
            F.date_format("submitted_at", SUBMITTED_TEXT).alias(date_col),
        )

    def fetch(keys, few):
        rows = overlaid(with_history(subs, keys.select("submission_id"), few), keys.select("file_id"))
        rows = shared(J.enrich_submissions(rows, orgs, V.persons(spark, sf_dir)))
        return rows.select(
            "*",
            F.when(F.col("organisation_type") == "CS", F.col("organisation_id"))
            .alias("compliance_scheme_id"),
            P.map_org_size("organisation_size").alias("producer_type"),
            F.col("person_id").alias("user_id"),
            *columns)

    listed = overlaid(subs) if FL.csv_items(statuses) else subs
    listed = _list_filters(shared(J.enrich_submissions(listed, orgs)), statuses=statuses, years=years, **filters)
    order = [F.col(date_col).desc(), F.col("submission_id").asc()]
    page = W.page_plain(listed.select(date_col, "submission_id", "file_id"), order, page_number, page_size)
    return _fetch_page(page, order, fetch, schema)


def pom_summaries(spark: SparkSession, sf_dir: str, decisions=None, organisation_name=None,
                  organisation_reference=None, statuses: str | None = None,
                  organisation_type=None, years: str | None = None, periods: str | None = None,
                  page_size: int = 20, page_number: int = 1,
                  decision_order: list[str] | None = None, user_id: int | None = None) -> W.Page:
    """Q1: POM submission list with pending decisions overlaid, one plain page.

    ``user_id`` is the regulator user who asks (``_visible_organisations``).
    """
    columns = [
        F.concat(F.lit("pom_"), F.col("submission_id").cast("string"), F.lit(".csv"))
        .alias("pom_file_name"),
        F.col("file_id").alias("pom_blob_name"),
    ]
    return _summary_page(spark, sf_dir, "Producer", schemas.POM_SUMMARY, "submitted_date", columns, decisions,
                         decision_order, user_id, page_number, page_size, statuses, years,
                         organisation_name=organisation_name, organisation_reference=organisation_reference,
                         organisation_type=organisation_type, periods=periods)


def registration_summaries(spark: SparkSession, sf_dir: str, decisions=None,
                           organisation_name=None, organisation_reference=None,
                           statuses: str | None = None, organisation_type=None,
                           years: str | None = None, periods: str | None = None,
                           page_size: int = 20, page_number: int = 1,
                           decision_order: list[str] | None = None, user_id: int | None = None) -> W.Page:
    """Q2: registration submission list with pending decisions overlaid, one plain page.

    ``user_id`` is the regulator user who asks (``_visible_organisations``).
    """
    columns = [
        F.col("file_id").alias("company_details_file_id"),
        F.concat(F.lit("company_details_"), F.col("submission_id").cast("string"), F.lit(".csv"))
        .alias("company_details_file_name"),
        F.col("file_id").alias("company_details_blob_name"),
    ]
    return _summary_page(spark, sf_dir, "Registration", schemas.REGISTRATION_SUMMARY, "registration_date", columns,
                         decisions, decision_order, user_id, page_number, page_size, statuses, years,
                         organisation_name=organisation_name, organisation_reference=organisation_reference,
                         organisation_type=organisation_type, periods=periods)


# Q5 / Q6 -------------------------------------------------------------------
def _registration_rows(spark, sf_dir, years=None, ids=None, few=False, orgs=None) -> DataFrame:
    subs = with_history(V.submissions(spark, sf_dir, years=years, kind="Registration"), ids, few)
    orgs = orgs if orgs is not None else V.organisations(spark, sf_dir)
    return _registration_columns(J.enrich_submissions(subs, orgs, V.persons(spark, sf_dir)))


def _registration_columns(rows: DataFrame) -> DataFrame:
    decided = F.col("status") != V.STATUS_PENDING
    decision_date = F.date_format(F.col("submitted_at") + F.lit(DECISION_DELAY), SUBMITTED_TEXT)
    submitted_text = F.date_format("submitted_at", SUBMITTED_TEXT)
    resub = F.col("is_resubmission")
    return rows.select(
        "*",
        F.when(F.col("organisation_type") == "CS", F.lit("CsoLargeProducer"))
        .when(F.col("organisation_size") == "L", F.lit("DirectLargeProducer"))
        .otherwise(F.lit("DirectSmallProducer")).alias("registration_journey"),
        F.col("status").alias("submission_status"),
        F.when(F.col("status") == V.STATUS_PENDING, submitted_text).alias("status_pending_date"),
        F.concat(F.lit("APP"), F.lpad(F.col("submission_id").cast("string"), 8, "0"))
        .alias("application_reference_number"),
        F.when(F.col("status") == V.STATUS_ACCEPTED,
               F.concat(F.lit("R"), F.col("submission_year").cast("string"),
                        F.lpad(F.col("organisation_id").cast("string"), 6, "0")))
        .alias("registration_reference_number"),
        (F.col("submission_year") + 1).cast("int").alias("relevant_year"),
        submitted_text.alias("submitted_date_time"),
        F.when(decided, decision_date).alias("regulator_decision_date"),
        F.when(resub, F.col("status")).alias("resubmission_status"),
        F.when(resub, submitted_text).alias("resubmission_date"),
        F.when(F.col("status") == V.STATUS_ACCEPTED, decision_date).alias("registration_date"),
    )


def organisation_registration_summaries(
        spark: SparkSession, sf_dir: str, names: str | None = None,
        references: str | None = None, years: str | None = None,
        statuses: str | None = None, resubmission_statuses: str | None = None,
        org_types: str | None = None, nation_id: int | None = None,
        app_refs: str | None = None, page_size: int = 20, page_number: int = 1) -> W.Page:
    """Q5: organisation registration list, clamped paging.

    The page is chosen first; its choice needs the history only where
    resubmission statuses are asked for.
    """
    FL.validate_nation(nation_id)
    subs = V.submissions(spark, sf_dir, years=_years_of_csv(years), kind="Registration")
    if FL.csv_items(resubmission_statuses):
        subs = with_history(subs)
    else:
        subs = subs.withColumn("is_resubmission", F.lit(None).cast("boolean"))
    rows = _registration_columns(J.enrich_submissions(subs, V.organisations(spark, sf_dir)))
    name_items = FL.csv_items(names)
    if name_items:
        rows = rows.filter(FL.any_of(*[F.lower(F.col("organisation_name")).contains(n.lower())
                                       for n in name_items]))
    rows = FL.filter_csv(rows, "organisation_reference", references)
    if years:
        rows = rows.filter(F.col("submission_year").isin(_years_of_csv(years)))
    rows = FL.filter_csv(rows, "submission_status", statuses)
    rows = FL.filter_csv(rows, "resubmission_status", resubmission_statuses)
    rows = FL.filter_csv(rows, "organisation_type", org_types)
    rows = FL.filter_optional_eq(rows, "nation_id", nation_id)
    rows = FL.filter_csv(rows, "application_reference_number", app_refs)
    order = [F.col("submitted_date_time").desc(), F.col("submission_id").asc()]
    # the filtered keys are written once; the count and the page come from them, not from the joins
    keys = cut_lineage(rows.select("submitted_date_time", "submission_id"))
    page = W.page_clamped(keys, order, page_number, page_size)
    return _fetch_page(
        page, order,
        lambda keys, few: _registration_rows(spark, sf_dir, _years_of_csv(years), keys.select("submission_id"), few),
        schemas.ORGANISATION_REGISTRATION_SUMMARY)


def organisation_registration_detail(spark: SparkSession, sf_dir: str,
                                     submission_id: int | DataFrame | None = None,
                                     organisations: DataFrame | None = None,
                                     rejects: Observation | None = None) -> DataFrame:
    """Q6: registration detail rows. One id -> at most one row (L3); a DataFrame
    of ids or ``None`` (all) -> one row per submission (bulk form).

    ``organisations`` takes the place of the stored ones (a delivery that is still
    text, say): a cell that does not convert takes its default, and
    ``rejects`` counts it per field in the pass that computes the rows (N6).
    """
    single = submission_id is not None and not isinstance(submission_id, DataFrame)
    out = N.align_schema(_detail_rows(spark, sf_dir, submission_id, organisations),
                         schemas.ORGANISATION_REGISTRATION_DETAIL, rejects=rejects)
    return W.first_or_none(out, ["submission_id"]) if single else out


def registration_detail_rejects(spark: SparkSession, sf_dir: str, organisations: DataFrame,
                                submission_id: int | DataFrame | None = None) -> DataFrame:
    """The cells that Q6 defaults: ``submission_id``, ``column_name``, ``value``."""
    return N.reject_rows(_detail_rows(spark, sf_dir, submission_id, organisations),
                         schemas.ORGANISATION_REGISTRATION_DETAIL, ["submission_id"])


def _detail_rows(spark, sf_dir, submission_id=None, organisations=None) -> DataFrame:
    if isinstance(submission_id, str) and not submission_id.strip():
        raise ValueError("submission id must not be empty")
    rows = _registration_rows(spark, sf_dir, ids=submission_id, orgs=organisations)
    # subsidiary counts of the registration file (A4), per file and organisation
    files = V.submissions(spark, sf_dir, kind="Registration")
    if submission_id is not None:
        files = FL.filter_key(files, "submission_id", submission_id)
    counts = A.fee_counts(V.pom_lines(spark, sf_dir, files, with_part=False), ["file_id", "organisation_id"],
                          "subsidiary_key",
                          {"number_of_online_subsidiaries": "is_online_marketplace_line",
                           "number_of_subsidiaries_closed_loop_recycling": "is_closed_loop_line"}, {})
    rows = rows.join(counts, ["file_id", "organisation_id"], "left")
    return rows.select(
        "*",
        F.lit(False).alias("is_late_submission"),
        (F.col("organisation_type") == "CS").alias("is_compliance_scheme"),
        F.when(F.col("status") == V.STATUS_REJECTED, F.col("comments")).alias("regulator_comment"),
        F.col("person_id").alias("submitted_user_id"),
        F.col("is_online_marketplace").alias("is_online_market_place"),
        F.col("file_id").alias("company_details_file_id"),
        F.concat(F.lit("company_details_"), F.col("submission_id").cast("string"), F.lit(".csv"))
        .alias("company_details_file_name"),
        F.col("file_id").alias("company_details_blob_name"),
    )


# Q7 ------------------------------------------------------------------------
def requested_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission ids that the event store asks about (data-derived request list)."""
    return V.submission_events(spark, sf_dir).select("submission_id").distinct()


def resubmission_pay_parameters(spark: SparkSession, sf_dir: str,
                                requested: DataFrame | None = None,
                                compliance_scheme_id: int | None = None) -> DataFrame:
    """Q7: pay parameters of POM resubmissions plus the readiness outcome.

    A submission is found if it is stored; its lines are counted, none is 0.
    """
    requested = requested if requested is not None else requested_from_events(spark, sf_dir)
    subs = with_history(V.submissions(spark, sf_dir, kind="Producer"), requested)
    orgs = V.organisations(spark, sf_dir).select("organisation_id", "organisation_type", "nation_code")
    subs = J.enrich_submissions(subs, orgs)
    subs = subs.withColumn("compliance_scheme_id",
                           F.when(F.col("organisation_type") == "CS", F.col("organisation_id")))
    subs = FL.filter_optional_eq(subs, "compliance_scheme_id", compliance_scheme_id)
    lines = FL.filter_key(V.line_members(spark, sf_dir), "submission_id", requested)
    params = A.resubmission_parameters(subs, lines, "submission_id", "subsidiary_key", "submitted_at",
                                       "is_resubmission", "nation_code")
    events = N.evolve_schema(V.submission_events(spark, sf_dir),
                             {"packaging_resubmission_reference_number": "string"})
    field_available = "packaging_resubmission_reference_number" in events.columns
    with_ref = N.evolve_schema(V.submission_events(spark, sf_dir, with_reference_only=True),
                               {"packaging_resubmission_reference_number": "string"})
    refs = J.latest_per_key(
        with_ref.filter(F.col("packaging_resubmission_reference_number").isNotNull()),
        "submission_id", ["load_ts", "submission_event_id"],
        ["packaging_resubmission_reference_number"])
    params = (params.join(refs, "submission_id", "left")
              .withColumnRenamed("packaging_resubmission_reference_number", "reference")
              .withColumn("_found", F.lit(True)))
    out = requested.select("submission_id").join(params, "submission_id", "left")
    return out.select(
        "submission_id", "is_resubmission", "resubmission_date", "member_count", "reference",
        "nation_code", F.lit(field_available).alias("reference_field_available"),
        P.classify_readiness("_found", F.lit(field_available), "reference").alias("outcome"))


def of_file(df: DataFrame, file_id) -> DataFrame:
    """A scan hint: the rows of one file by their numeric key (pushed); other forms pass unchanged."""
    key = None if isinstance(file_id, DataFrame) or file_id is None else V.key_of_file_id(file_id)
    return df if key is None else df.filter(F.col("submission_id") == key)


# Q8 / Q9 -------------------------------------------------------------------
def sync_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: per submission, has it arrived in the event store (null/no row -> false)."""
    subs = V.submissions(spark, sf_dir).select("submission_id", "file_id")
    return J.exists_synced(subs, V.submission_events(spark, sf_dir), "submission_id", "is_synced")


def resubmission_synchronised(spark: SparkSession, sf_dir: str, file_id: str | None = None) -> DataFrame:
    """Q9: per file, arrived AND known with a non-blank resubmission reference.

    One ``file_id`` is looked up by its key in all three scans.
    """
    files = of_file(V.submissions(spark, sf_dir), file_id).select("file_id")
    if file_id is not None:
        files = FL.filter_key(files, "file_id", str(file_id).strip().lower())
    events = of_file(V.submission_events(spark, sf_dir), file_id)
    ref = F.col("packaging_resubmission_reference_number")
    known = of_file(V.submission_events(spark, sf_dir, with_reference_only=True), file_id) \
        .filter(ref.isNotNull() & (F.trim(ref) != ""))
    return J.exists_both(files, events, known, "file_id", "is_synchronised")


# Q10 -----------------------------------------------------------------------
def stored_actual_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual period per POM file; null for the quarterly periods (no stored value)."""
    subs = V.submissions(spark, sf_dir, kind="Producer")
    year = F.col("submission_year").cast("string")
    return subs.select(
        "submission_id", "file_id",
        F.when(F.col("submission_period").endswith("-H1"), F.concat(F.lit("January to June "), year))
        .when(F.col("submission_period").endswith("-H2"),
              F.concat(F.lit("January to December "), year))
        .alias("stored_period"))


def actual_submission_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: sanitised id + decoded label, looked up with fallback."""
    raw = V.raw_text(spark, sf_dir)
    req = raw.select(N.sanitise_id("file_id_crlf").alias("file_id"),
                     N.decode_period("period_label").alias("requested_period"))
    return J.lookup_period(req, stored_actual_periods(spark, sf_dir), "file_id",
                           "stored_period", "requested_period")


# Q11 / Q12 -----------------------------------------------------------------
def _updated_organisations(spark, sf_dir, start, end) -> DataFrame:
    lo, hi = (dt.datetime.fromisoformat(str(start)), dt.datetime.fromisoformat(str(end)))
    years = list(range(lo.year, hi.year + 1)) if lo <= hi else []
    subs = V.submissions(spark, sf_dir, years=years, submitted_between=(start, end))
    subs = FL.filter_delta_window(subs, "submitted_at", start, end)
    latest = J.latest_per_key(subs, "organisation_id", ["submitted_at", "submission_id"],
                              ["submitted_at", "status"])
    rows = J.enrich_submissions(latest, V.organisations(spark, sf_dir))
    return rows.select(
        "*",
        F.col("submitted_at").alias("updated_date_time"),
        F.concat(F.lit("PRD"), F.lpad(F.col("organisation_id").cast("string"), 8, "0"))
        .alias("peprid"),
    )


def updated_producers(spark: SparkSession, sf_dir: str, start, end) -> DataFrame:
    """Q11: organisations changed in [start, end], latest change each."""
    rows = _updated_organisations(spark, sf_dir, start, end)
    return N.align_schema(rows.withColumn("organisation_id", F.col("organisation_id").cast("string")),
                          schemas.UPDATED_PRODUCERS)


def updated_producers_v2(spark: SparkSession, sf_dir: str, start, end) -> DataFrame:
    """Q12: as Q11 without the organisation id, with the registration year."""
    rows = _updated_organisations(spark, sf_dir, start, end)
    rows = rows.withColumn("registration_year", F.year("updated_date_time").cast("string"))
    return N.align_schema(rows, schemas.UPDATED_PRODUCERS_V2)


def changed_producers(spark: SparkSession, sf_dir: str, old: DataFrame, new: DataFrame, updated_at) -> DataFrame:
    """Q11 from two vintages of the organisations: what arrived, changed or left between them.

    ``status`` is the change; ``updated_at`` is the instant of the newer vintage.
    Changes of any column that the extract shows count, others do not.
    """
    shown = [c for c in new.columns if c in schemas.UPDATED_PRODUCERS.fieldNames() and c != "organisation_id"]
    rows = CH.change_set(old, new, ["organisation_id"], shown)
    rows = rows.select(
        "*", F.col("change").alias("status"), F.lit(instant_text(updated_at)).alias("updated_date_time"),
        F.concat(F.lit("PRD"), F.lpad(F.col("organisation_id").cast("string"), 8, "0")).alias("peprid"))
    return N.align_schema(rows, schemas.UPDATED_PRODUCERS)


# Q13 -----------------------------------------------------------------------
def registration_fee_details(spark: SparkSession, sf_dir: str,
                             file_id: str | DataFrame | None = None) -> DataFrame:
    """Q13: per organisation of a registration file: subsidiary counts and own flags."""
    subs = V.submissions(spark, sf_dir, kind="Registration")
    if file_id is not None:
        subs = FL.filter_key(of_file(subs, file_id), "file_id", file_id)
    lines = V.pom_lines(spark, sf_dir, subs, with_part=False)
    counts = A.fee_counts(lines, ["file_id", "organisation_id"], "subsidiary_key",
                          {"number_of_subsidiaries_being_online_market_place": "is_online_marketplace_line",
                           "number_of_subsidiaries_being_closed_loop_recycling": "is_closed_loop_line"},
                          {})
    orgs = V.organisations(spark, sf_dir)
    return counts.join(orgs, "organisation_id", "inner").select(
        "file_id", "organisation_id", "number_of_subsidiaries",
        "number_of_subsidiaries_being_online_market_place",
        "number_of_subsidiaries_being_closed_loop_recycling",
        P.map_org_size("organisation_size").alias("organisation_size"),
        "is_online_marketplace", "is_closed_loop_recycling", "is_new_joiner", "nation_id")


# Q14 / Q15 -----------------------------------------------------------------
def paycal_organisations(spark: SparkSession, sf_dir: str, relative_year: int,
                         warehouse: dict | None = None) -> DataFrame:
    """Q14: organisation rows of the relative year with half-year flags."""
    year = FL.validate_relative_year(relative_year)
    subs = (LY.read_stored(spark, warehouse["submissions"], years=[year]) if warehouse
            else V.submissions(spark, sf_dir, years=[year]))
    subs = FL.filter_relative_year(subs, "submission_year", year, 0)
    flags = A.half_year_flags(subs, ["organisation_id", "submission_year"])
    rows = flags.join(V.organisations(spark, sf_dir), "organisation_id", "inner")
    rows = rows.select(
        "*",
        F.lit(None).cast("string").alias("subsidiary_id"),
        F.lit(None).cast("string").alias("error_code"),
        F.col("organisation_id").cast("string").alias("submitter_id"),
        F.col("submission_year").alias("submission_period_year"),
    )
    return PR.project_organisation(rows)


def period_description(period_col: str = "submission_period"):
    """Text of a period label for the POM extract, e.g. ``2025-H1`` -> ``January to June 2025``."""
    suffix = F.substring_index(F.col(period_col), "-", -1)
    year = F.substring_index(F.col(period_col), "-", 1)
    desc = None
    for code, text in HALF_DESCRIPTIONS:
        desc = (F.when(suffix == code, F.lit(text)) if desc is None
                else desc.when(suffix == code, F.lit(text)))
    return F.concat(desc, F.lit(" "), year)


def paycal_poms(spark: SparkSession, sf_dir: str, relative_year: int,
                warehouse: dict | None = None) -> DataFrame:
    """Q15: accepted POM lines of the year before the relative year.

    With ``warehouse`` the lines come from one year partition of the stored
    layout: a pruned scan and a projection, no join.
    """
    year = FL.validate_relative_year(relative_year)
    if warehouse is not None:
        lines = LY.read_stored(spark, warehouse["pom_lines"], years=[year - 1])
        lines = lines.filter((F.col("status") == V.STATUS_ACCEPTED)
                             & (F.col("submission_type") == "Producer"))
    else:
        subs = V.submissions(spark, sf_dir, years=[year - 1], kind="Producer",
                             statuses=[V.STATUS_ACCEPTED])
        subs = FL.filter_relative_year(subs, "submission_year", year, 1)
        subs = subs.filter(F.col("status") == V.STATUS_ACCEPTED)
        lines = V.pom_lines(spark, sf_dir, subs, subs_bound=subs)
    rows = lines.select(
        "*",
        period_description().alias("submission_period_description"),
        F.col("subsidiary_key").cast("string").alias("subsidiary_id"),
        F.col("person_id").cast("string").alias("submitter_id"),
    )
    return PR.project_pom(rows)
