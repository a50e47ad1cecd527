"""Domain views built from the driver's warehouse tables.

The submissions warehouse is represented by the TPC-H-like driver tables;
each view below states its rule once. Every view is a lazy DataFrame, so the
reports composed on top of them are optimised as a whole by Catalyst: only
the columns a report uses are read, and filters on raw columns reach the
parquet scan.

Scale notes
-----------
* ``submissions`` accepts ``years``, ``kind``, ``statuses`` and
  ``submitted_between`` hints, ``organisations`` a ``size`` and
  ``submission_events`` event-type hints. They become range / IN predicates
  on raw columns, which the parquet reader pushes down (row-group
  skipping). On a warehouse stored partitioned by submission year the year
  hint is partition pruning.
* No growing dimension is hinted for broadcast; joins are left to AQE,
  which broadcasts a side only when its runtime size is under the
  threshold. The one explicit broadcast is the filtered submission side of
  ``pom_lines``, behind a bounded row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.operators.joins import bounded_broadcast
from regsight.sources.tables import is_table, read_path, read_table, session_key, ts_ntz

# ---------------------------------------------------------------------------
# Fixed values of the stand-in mapping (input definition, not logic).
# ---------------------------------------------------------------------------
YEAR_SHIFT = 29
FILE_ID_PREFIX = "00000000-0000-4000-8000-"
# order status -> submission status; any other status is "Rejected"
STATUS_ACCEPTED, STATUS_PENDING, STATUS_REJECTED = "Accepted", "Pending", "Rejected"
# order priorities whose orders stand for registration submissions
REGISTRATION_PRIORITIES = ("1-URGENT", "2-HIGH")
# organisation size code by market segment; BUILDING has no code (null)
SIZE_BY_SEGMENT = (("MACHINERY", "L"), ("AUTOMOBILE", "s"),
                   ("FURNITURE", "x"), ("HOUSEHOLD", " "))
# packaging type by part type; CW is outside the configured type list
PACKAGING_TYPE_BY_PART_TYPE = (("PROMO", "HH"), ("SMALL", "NH"), ("MEDIUM", "PB"),
                               ("LARGE", "HDC"), ("STANDARD", "NDC"), ("ECONOMY", "CW"))
# packaging material: item (1 + p_size % 8) of this list; OT is outside the list
MATERIALS = ("AL", "FC", "GL", "PC", "PL", "ST", "WD", "OT")
# nation code by nation id 1..4
NATION_CODES = ("GB-ENG", "GB-NIR", "GB-SCT", "GB-WLS")
COMPLIANCE_SCHEME_BALANCE = 2000.0  # organisations below this balance are schemes


SUBMISSION_COLUMNS = ("submission_id", "file_id", "organisation_id", "submission_type", "status",
                      "submitted_at", "submission_year", "submission_period", "comments",
                      "person_id")
LINE_COLUMNS = ("subsidiary_key", "packaging_type", "packaging_material",
                "packaging_material_subtype", "packaging_material_weight", "packaging_class",
                "packaging_activity", "ram_rag_rating", "is_online_marketplace_line",
                "is_closed_loop_line")

PART_COLUMNS = ("packaging_type", "packaging_material", "packaging_material_subtype")

# Stored layouts opened per session (see ``use_warehouse``).
_WAREHOUSES: dict[int, dict[str, str]] = {}


def use_warehouse(spark: SparkSession, paths: dict[str, str] | None) -> None:
    """Serve ``submissions`` / ``pom_lines`` of this session from a stored layout.

    ``paths`` is what ``layout.write_warehouse`` returns; ``None`` goes back
    to deriving the views from the warehouse tables. Every report then reads
    the stored, year-partitioned tables: year filters prune directories and
    the lines join to a filtered submission set carries the year, so
    dynamic partition pruning applies to it. A bucketed layout
    (``layout.write_bucketed``) is named by its tables; joins on the
    submission id then need no shuffle, so a join on id and year may use the
    id's buckets.
    """
    key = session_key(spark)
    if paths is None:
        _WAREHOUSES.pop(key, None)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        return
    _WAREHOUSES[key] = dict(paths)
    if any(is_table(p) for p in paths.values()):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _stored(spark: SparkSession, name: str) -> str | None:
    return _WAREHOUSES.get(session_key(spark), {}).get(name)


def file_id_of(key: Column) -> Column:
    """Canonical lower-case GUID text for a numeric key."""
    return F.concat(F.lit(FILE_ID_PREFIX), F.lpad(key.cast("string"), 12, "0"))


def key_of_file_id(file_id: str) -> int | None:
    """The numeric key behind a file id text; None if the text is no file id of ours."""
    text = str(file_id).strip().lower()
    digits = text.removeprefix(FILE_ID_PREFIX)
    return int(digits) if digits != text and len(digits) == 12 and digits.isdecimal() else None


def _lookup(col: Column, pairs, default=None) -> Column:
    expr = None
    for key, value in pairs:
        expr = (F.when(col == key, value) if expr is None
                else expr.when(col == key, value))
    return expr.otherwise(default) if default is not None else expr


def period_of(ts: Column) -> Column:
    """Submission period label: ``Y-P1``/``Y-P4`` up to 2024, ``Y-H1``/``Y-H2`` after."""
    year = F.year(ts).cast("string")
    first_half = F.month(ts) <= 6
    return (F.when(F.year(ts) <= 2024,
                   F.concat(year, F.when(first_half, F.lit("-P1")).otherwise(F.lit("-P4"))))
            .otherwise(F.concat(year, F.when(first_half, F.lit("-H1")).otherwise(F.lit("-H2")))))


def _year_range_predicate(years) -> Column | None:
    """Range predicate on the raw order date covering the shifted ``years``."""
    pred = None
    for year in sorted({int(y) for y in years}):
        raw = year - YEAR_SHIFT
        one = ((F.col("o_orderdate") >= ts_ntz(f"{raw:04d}-01-01 00:00:00"))
               & (F.col("o_orderdate") < ts_ntz(f"{raw + 1:04d}-01-01 00:00:00")))
        pred = one if pred is None else (pred | one)
    return pred


def _status_predicate(statuses) -> Column:
    """Raw ``o_orderstatus`` predicate selecting the given submission statuses."""
    raw = {STATUS_ACCEPTED: "F", STATUS_PENDING: "O"}
    wanted = set(statuses)
    unknown = wanted - {STATUS_ACCEPTED, STATUS_PENDING, STATUS_REJECTED}
    if unknown:
        raise ValueError(f"unknown submission status {sorted(unknown)}")
    codes = [raw[s] for s in sorted(wanted) if s in raw]
    col = F.col("o_orderstatus")
    pred = col.isin(*codes) if codes else F.lit(False)
    if STATUS_REJECTED in wanted:
        pred = pred | ~col.isin("F", "O") | col.isNull()
    return pred


def _submitted_range_predicate(lo: str | None, hi: str | None) -> Column | None:
    """Raw ``o_orderdate`` range that contains every row whose shifted date is in [lo, hi].

    The shift adds whole years; month-end clamping (29 February) moves a date
    by at most a day, so the raw bounds are widened by two days. The exact
    predicate on the shifted column is applied by the caller.
    """
    pred = None
    if lo is not None:
        pred = F.col("o_orderdate") >= (ts_ntz(str(lo)) - F.make_ym_interval(F.lit(YEAR_SHIFT))
                                        - F.expr("INTERVAL 2 DAYS"))
    if hi is not None:
        upper = F.col("o_orderdate") <= (ts_ntz(str(hi)) - F.make_ym_interval(F.lit(YEAR_SHIFT))
                                         + F.expr("INTERVAL 2 DAYS"))
        pred = upper if pred is None else pred & upper
    return pred


def _stored_submissions(spark, path, years, kind, statuses, submitted_between) -> DataFrame:
    df = read_path(spark, path)
    if years is not None:
        df = df.filter(F.col("submission_year").isin([int(y) for y in years]))
    if statuses is not None:
        df = df.filter(F.col("status").isin(list(statuses)))
    if kind is not None:
        df = df.filter(F.col("submission_type") == kind)
    if submitted_between is not None:
        lo, hi = submitted_between
        if lo is not None:
            df = df.filter(F.col("submitted_at") >= ts_ntz(str(lo)))
        if hi is not None:
            df = df.filter(F.col("submitted_at") <= ts_ntz(str(hi)))
    return df.select(*SUBMISSION_COLUMNS)


def submissions(spark: SparkSession, sf_dir: str, years=None,
                kind: str | None = None, statuses=None,
                submitted_between: tuple[str | None, str | None] | None = None,
                derive: bool = False, with_raw_date: bool = False) -> DataFrame:
    """One row per submission (``orders``).

    columns: submission_id, file_id, organisation_id, submission_type, status,
    submitted_at, submission_year, submission_period, comments, person_id

    ``years``, ``kind``, ``statuses`` and ``submitted_between`` are applied as
    predicates on the raw columns, so they reach the parquet scan as pushed
    filters (``submitted_between`` is a superset hint; filter the exact range
    on ``submitted_at``). With a stored layout in use (``use_warehouse``) and
    not ``derive``, the stored table is read instead. ``with_raw_date`` adds
    ``raw_date``, the date before the shift: a range on it reaches the scan
    where one on ``submitted_at`` does not.
    """
    if kind not in (None, "Registration", "Producer"):
        raise ValueError(f"unknown submission kind {kind!r}")
    stored = None if derive else _stored(spark, "submissions")
    if stored is not None:
        out = _stored_submissions(spark, stored, years, kind, statuses, submitted_between)
        raw = F.col("submitted_at") - F.make_ym_interval(F.lit(YEAR_SHIFT))
        return out.withColumn("raw_date", raw) if with_raw_date else out
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                                  "o_orderdate", "o_orderpriority"])
    if years is not None:
        pred = _year_range_predicate(years)
        orders = orders.filter(pred if pred is not None else F.lit(False))
    if statuses is not None:
        orders = orders.filter(_status_predicate(statuses))
    if submitted_between is not None:
        pred = _submitted_range_predicate(*submitted_between)
        if pred is not None:
            orders = orders.filter(pred)
    is_registration = F.col("o_orderpriority").isin(*REGISTRATION_PRIORITIES)
    if kind == "Registration":
        orders = orders.filter(is_registration)
    elif kind == "Producer":
        orders = orders.filter(~is_registration)
    suppliers = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    n_persons = suppliers.select(F.count(F.lit(1))).scalar()
    submitted = F.col("o_orderdate") + F.make_ym_interval(F.lit(YEAR_SHIFT))
    return orders.select(
        F.col("o_orderkey").alias("submission_id"),
        file_id_of(F.col("o_orderkey")).alias("file_id"),
        F.col("o_custkey").alias("organisation_id"),
        F.when(is_registration, F.lit("Registration")).otherwise(F.lit("Producer"))
        .alias("submission_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit(STATUS_ACCEPTED))
        .when(F.col("o_orderstatus") == "O", F.lit(STATUS_PENDING))
        .otherwise(F.lit(STATUS_REJECTED)).alias("status"),
        submitted.alias("submitted_at"),
        F.year(submitted).cast("int").alias("submission_year"),
        period_of(submitted).alias("submission_period"),
        F.col("o_orderpriority").alias("comments"),
        (F.col("o_orderkey") % n_persons).alias("person_id"),
        *([F.col("o_orderdate").alias("raw_date")] if with_raw_date else []),
    )


def organisations(spark: SparkSession, sf_dir: str, size: str | None = None) -> DataFrame:
    """One row per organisation (``customer`` joined to ``nation`` and ``region``).

    ``size`` keeps one size code, as a pushed predicate on the raw segment.
    """
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey",
                                                      "c_acctbal", "c_mktsegment"])
    if size is not None:
        segments = [seg for seg, code in SIZE_BY_SEGMENT if code == size]
        customer = customer.filter(F.col("c_mktsegment").isin(*segments) if segments
                                   else F.lit(False))
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    bal = F.col("c_acctbal")
    nation_id = (F.lit(1) + F.col("n_regionkey") % 4).cast("int")
    new_joiner = (bal >= 0) & (bal < 1000)
    return customer.join(geo, customer.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").alias("organisation_id"),
        F.col("c_name").alias("organisation_name"),
        F.concat(F.col("c_name"), F.lit(" Trading")).alias("trading_name"),
        (F.lit(100000) + F.col("c_custkey")).cast("string").alias("organisation_reference"),
        F.when(bal < COMPLIANCE_SCHEME_BALANCE, F.lit("CS")).otherwise(F.lit("DP"))
        .alias("organisation_type"),
        _lookup(F.col("c_mktsegment"), SIZE_BY_SEGMENT).alias("organisation_size"),
        nation_id.alias("nation_id"),
        F.element_at(F.array(*[F.lit(c) for c in NATION_CODES]), nation_id).alias("nation_code"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("companies_house_number"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("business_country"),
        F.concat(F.lit("PC"), F.col("c_nationkey").cast("string")).alias("postcode"),
        F.when(bal < 0, F.lit(None).cast("smallint"))
        .otherwise((F.lit(1) + F.col("c_custkey") % 365).cast("smallint"))
        .alias("num_days_obligated"),
        (bal >= 9000).alias("is_online_marketplace"),
        (bal < 0).alias("is_closed_loop_recycling"),
        new_joiner.alias("is_new_joiner"),
        F.when(bal < 0, F.lit("Left")).otherwise(F.lit("Active")).alias("status_code"),
        F.when(bal < 0, F.lit("NotObligated")).otherwise(F.lit("Obligated"))
        .alias("obligation_status"),
        F.when(new_joiner, F.lit("2025-01-01")).alias("joiner_date"),
        F.when(bal < 0, F.lit("2025-12-31")).alias("leaver_date"),
    )


def organisation_vintage(spark: SparkSession, sf_dir: str, vintage: int) -> DataFrame:
    """``organisations`` as of an earlier (1) or the present load (2).

    Between the two, by key: every 13th organisation arrives, every 11th leaves
    (and is gone from the second), every 7th changes its postcode, every 5th a null county.
    """
    key, orgs = F.col("organisation_id"), organisations(spark, sf_dir)
    early, arrives, leaves = vintage == 1, key % 13 == 0, key % 11 == 0
    county = F.when(key % 5 == 0, F.lit(None if early else "")).otherwise(F.lit("County"))
    moved = F.when(key % 7 == 0, F.concat("postcode", F.lit("A"))).otherwise(F.col("postcode"))
    out = orgs.withColumn("county", county).withColumn("postcode", F.col("postcode") if early else moved)
    return out.filter(~arrives if early else ~leaves | arrives)


def organisations_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``organisations`` as a delivery before conversion: text cells, some of them bad by key."""
    key, orgs = F.col("organisation_id"), organisations(spark, sf_dir)
    return orgs.withColumns({
        "nation_id": F.when(key % 10 == 0, F.lit("n/a")).when(key % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("nation_id").cast("string")),
        "is_online_marketplace": F.when(key % 15 == 0, F.lit("perhaps"))
        .otherwise(F.col("is_online_marketplace").cast("string"))})


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitting persons (``supplier``)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    return s.select(
        F.col("s_suppkey").alias("person_id"),
        F.col("s_name").alias("first_name"),
        F.concat(F.lit("Nation"), F.col("s_nationkey").cast("string")).alias("last_name"),
        F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@example.com"))
        .alias("email"),
        F.concat(F.lit("0"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0"))
        .alias("telephone"),
        F.when(F.col("s_acctbal") < 0, F.lit("Basic User"))
        .otherwise(F.lit("Approved Person")).alias("service_role"),
    )


def regulator_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulator users (``supplier``) and the nation each of them regulates."""
    users = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    return users.join(nation, users.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("user_id"), (F.lit(1) + F.col("n_regionkey") % 4).cast("int").alias("nation_id"))


# event types that carry a regulator decision / a resubmission reference
DECISION_EVENT_TYPES = ("purchase", "error")
REFERENCE_EVENT_TYPES = ("signup", "view")


def submission_events(spark: SparkSession, sf_dir: str, decided_only: bool = False,
                      with_reference_only: bool = False) -> DataFrame:
    """Event store rows (``events``): what has been synchronised, and when.

    ``decided_only`` / ``with_reference_only`` keep the rows whose decision /
    resubmission reference can be non-null, as pushed predicates on the raw
    ``event_type`` column.
    """
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    if decided_only:
        e = e.filter(F.col("event_type").isin(*DECISION_EVENT_TYPES))
    if with_reference_only:
        e = e.filter(F.col("event_type").isin(*REFERENCE_EVENT_TYPES))
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("submission_event_id"),
        F.col("ts").alias("load_ts"),
        F.col("user_id").alias("submission_id"),
        file_id_of(F.col("user_id")).alias("file_id"),
        et.alias("event_type"),
        F.when(et == DECISION_EVENT_TYPES[0], F.lit(STATUS_ACCEPTED))
        .when(et == DECISION_EVENT_TYPES[1], F.lit(STATUS_REJECTED)).alias("decision"),
        F.col("props").alias("comments"),
        (et == "error").alias("is_resubmission_required"),
        F.when(et == REFERENCE_EVENT_TYPES[0],
               F.concat(F.lit("PRN"), F.lpad(F.col("event_id").cast("string"), 8, "0")))
        .when(et == REFERENCE_EVENT_TYPES[1], F.lit("")).alias("packaging_resubmission_reference_number"),
    )


# ~120 bytes per submission row after pruning: 200k rows is ~25 MB per executor
SUBMISSION_BROADCAST_ROWS = 200_000
# lines whose members one task tells apart: 457 MB were measured for 620,000 of them, joins and sorts included
TASK_LINES = 500_000


def pom_lines(spark: SparkSession, sf_dir: str, subs: DataFrame | None = None,
              subs_bound: DataFrame | None = None, derive: bool = False,
              with_part: bool = True, spread: bool = False) -> DataFrame:
    """Packaging lines (``lineitem`` joined to its submission and ``part``).

    Without ``with_part`` the columns of ``part`` (``PART_COLUMNS``) and the
    join they need are left out.

    ``subs`` lets a report pass an already-filtered submission frame so the
    filter is applied before the large join. ``subs_bound`` is a frame with
    at least as many rows as ``subs`` (typically the filtered scan before
    further joins): when it proves ``subs`` small, the submission side is
    broadcast and ``lineitem`` streams through without a shuffle; otherwise
    the join is left to the planner (shuffle join, AQE). ``spread`` deals the
    lines to as many tasks as ``TASK_LINES`` asks for, which the planner does not
    join up again: for what is held per line after the join. Stored lines stay as they are.
    """
    line_columns = [c for c in LINE_COLUMNS if with_part or c not in PART_COLUMNS]
    stored = None if derive else _stored(spark, "pom_lines")
    if stored is not None:
        lines = read_path(spark, stored)
        if subs is None:
            return lines.select(*SUBMISSION_COLUMNS, *line_columns)
        keys = ["submission_id"] + (["submission_year"] if "submission_year" in subs.columns else [])
        side = subs
        if subs_bound is not None:
            side = bounded_broadcast(subs, SUBMISSION_BROADCAST_ROWS, bound_from=subs_bound)
        return (lines.select(*keys, *line_columns).join(side, keys, "inner")
                .select(*subs.columns, *line_columns))
    subs = subs if subs is not None else submissions(spark, sf_dir, derive=derive)
    if subs_bound is not None:
        subs = bounded_broadcast(subs, SUBMISSION_BROADCAST_ROWS, bound_from=subs_bound)
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey",
                                                "l_linenumber", "l_quantity", "l_tax",
                                                "l_returnflag"])
    if spread and (tasks := -(-li.count() // TASK_LINES)) > 1:
        li = li.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")
    joined = li.join(subs, li.l_orderkey == subs.submission_id, "inner")
    if with_part:
        part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
        joined = joined.join(part, li.l_partkey == part.p_partkey, "inner")
    material = F.element_at(F.array(*[F.lit(m) for m in MATERIALS]),
                            (F.lit(1) + F.col("p_size") % 8).cast("int"))
    of_part = [_lookup(F.col("p_type"), PACKAGING_TYPE_BY_PART_TYPE).alias("packaging_type"),
               material.alias("packaging_material"),
               F.when(material == "PL", F.lit("Rigid")).alias("packaging_material_subtype")]
    return joined.select(
        *[c for c in subs.columns],
        F.col("l_suppkey").alias("subsidiary_key"),
        *(of_part if with_part else []),
        F.col("l_quantity").alias("packaging_material_weight"),
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("packaging_class"),
        F.when(F.col("l_returnflag") == "R", F.lit("Imported"))
        .when(F.col("l_returnflag") == "A", F.lit("SoldAsEmpty"))
        .otherwise(F.lit("Brand")).alias("packaging_activity"),
        F.when(F.col("l_tax") >= 0.06, F.lit("RED"))
        .when(F.col("l_tax") >= 0.03, F.lit("AMBER"))
        .otherwise(F.lit("GREEN")).alias("ram_rag_rating"),
        (F.col("l_returnflag") == "R").alias("is_online_marketplace_line"),
        (F.col("l_returnflag") == "A").alias("is_closed_loop_line"),
    )


def line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a submission's lines are for: ``submission_id`` and ``subsidiary_key`` per line, no join."""
    stored = _stored(spark, "pom_lines")
    if stored is not None:
        return read_path(spark, stored).select("submission_id", "subsidiary_key")
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"])
    return lines.select(F.col("l_orderkey").alias("submission_id"), F.col("l_suppkey").alias("subsidiary_key"))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns as an upstream system would deliver them (for N1-N9, S2, S3).

    Strict rules receive clean values; null, empty and blank cells are mixed
    in by key. Bad values for the lenient rules come from ``messy_*`` columns.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                             "o_orderdate"])
    key = F.col("o_orderkey")
    submitted = F.col("o_orderdate") + F.make_ym_interval(F.lit(YEAR_SHIFT))
    null_key, empty_key, blank_key = key % 11 == 0, key % 7 == 0, key % 13 == 0
    fid = file_id_of(key)
    stamp = F.concat(F.date_format(submitted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    half = F.when(F.month(submitted) <= 6, F.lit("January+to%20June+")) \
        .otherwise(F.lit("July+to%20December+"))
    return o.select(
        key.alias("submission_id"),
        F.when(null_key, F.lit(None).cast("string")).when(empty_key, F.lit(""))
        .otherwise(F.upper(fid)).alias("file_id_text"),
        F.when(null_key, F.lit(None).cast("string")).when(empty_key, F.lit(""))
        .otherwise(key.cast("string")).alias("key_text"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1))
        .when(F.col("o_orderstatus") == "O", F.lit(0)).otherwise(F.lit(-1))
        .alias("status_int"),
        F.when(null_key, F.lit(None).cast("string")).when(empty_key, F.lit(""))
        .otherwise(stamp).alias("submitted_text"),
        F.when(blank_key, F.lit("  ")).when(empty_key, F.lit(""))
        .when(null_key, F.lit(None).cast("string"))
        .otherwise((F.lit(100000) + F.col("o_custkey")).cast("string")).alias("reference_text"),
        F.concat(fid, F.lit("\r\n")).alias("file_id_crlf"),
        F.concat(half, F.year(submitted).cast("string")).alias("period_label"),
        F.when(key % 5 == 0, F.lit("n/a")).otherwise(key.cast("string")).alias("messy_int_text"),
        F.when(key % 9 == 0, F.lit("invalid date string"))
        .otherwise(F.date_format(submitted, "yyyy-MM-dd")).alias("messy_date_text"),
    )


def standin_schema_types() -> dict[str, T.DataType]:
    """Types of the id columns shared by all views (for documentation and tests)."""
    return {"submission_id": T.LongType(), "organisation_id": T.LongType(),
            "person_id": T.LongType(), "file_id": T.StringType()}
