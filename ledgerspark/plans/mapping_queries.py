"""Queries of the mapping operators, over headers and profiles that are
derived from the given tables by key arithmetic: one source file by order, one
profile by customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping as M
from ..schema import COMMON_FIELD_ALIASES, DEFAULT_REQUIRED_FIELDS, MAPPING_TARGETS, DirectAmount, FlaggedAmount, Profile
from ..sources import journal_fixture as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str):
    def deco(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return deco


# --- files: which alias of a key an order's header has -----------------------

# alias key -> (divisor of the order key, condition in both SQL dialects)
_HAS = {
    "book_date": (1, "k % 11 <> 0"),
    "voucher_no": (5, "k % 13 <> 0"),
    "ac_code": (2, "k % 17 <> 0"),
    "ac_name": (3, "true"),
    "summary": (7, "k % 5 <> 0"),
    "debit": (4, "k % 3 = 1"),
    "credit": (6, "k % 3 = 1"),
    "direct_amount": (8, "k % 3 = 0"),
}


def _chosen(key: str) -> Column:
    div, has = _HAS[key]
    names = COMMON_FIELD_ALIASES[key]
    at = F.floor(F.col("k") / div) % len(names)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    return F.when(F.expr(has), F.when(F.col("k") % 4 == 1, F.upper(name)).otherwise(name))


def _chosen_sql(key: str) -> str:
    div, has = _HAS[key]
    names = COMMON_FIELD_ALIASES[key]
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    name = f"{listed}[CAST((k // {div}) % {len(names)} AS INT) + 1]"
    return f"CASE WHEN {has} THEN CASE WHEN k % 4 = 1 THEN upper({name}) ELSE {name} END END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    names = [_chosen(key) for key in _HAS] + [F.when(k % 3 == 2, F.lit("amt")), F.when(k % 3 == 2, F.lit("flag"))]
    return orders.select(
        k.alias("file_id"),
        F.concat(F.lit("client-"), (F.col("o_custkey") % 7).cast("string")).alias("client_name"),
        F.when(k % 2 == 0, F.lit("excel")).otherwise(F.lit("csv")).alias("source_type"),
        F.concat(F.lit("S"), (k % 3).cast("string")).alias("source_sheet"),
        F.when(k % 3 == 2, F.lit("flag")).otherwise(F.lit("plain")).alias("profile_name"),
        F.filter(F.array(*names), lambda c: c.isNotNull()).alias("columns"),
    )


_FILES_SQL = (
    "WITH o AS (SELECT o_orderkey AS k, o_custkey FROM orders), files AS (SELECT k, o_custkey, "
    + ", ".join(f"{_chosen_sql(key)} AS {key}" for key in _HAS)
    + " FROM o)\n"
)


@register(
    "mapping_detect",
    _FILES_SQL
    + "SELECT k AS file_id, coalesce(book_date, '') AS book_date, coalesce(voucher_no, '') AS voucher_no, ac_code, "
    "coalesce(ac_name, '') AS ac_name, summary, debit AS debit_field, credit AS credit_field, "
    "direct_amount AS direct_amount_field FROM files",
)
def q_detect(spark, sf_dir):
    return M.detect_mapping(_files(spark, sf_dir))


_BLANK = {t: "" for t in DEFAULT_REQUIRED_FIELDS}


def _client_profiles(spark: SparkSession) -> DataFrame:
    """Two profiles for each client that the files name."""
    items = []
    for i in range(7):
        plain = {**_BLANK, "posting_date": "Book Date", "voucher_id": "凭证号"}
        items.append((f"client-{i}", Profile("plain", plain, DirectAmount("AMOUNT"))))
        items.append((f"client-{i}", Profile("flag", plain, FlaggedAmount("amt", "flag"))))
    return M.profiles_frame(spark, items)


_RESOLVED = {
    "posting_date": "book_date", "voucher_id": "voucher_no", "ac_code": "ac_code", "ac_caption": "ac_name",
    "description": "summary", "rc_amount": "direct_amount", "debit_amount": "debit", "credit_amount": "credit",
}


@register(
    "mapping_resolve",
    _FILES_SQL
    + "SELECT k AS file_id, "
    + ", ".join(f"{c} AS {t}" for t, c in _RESOLVED.items())
    + ", CASE WHEN k % 3 = 2 THEN 'amt' END AS amount, CASE WHEN k % 3 = 2 THEN 'flag' END AS drcr, "
    + "concat_ws(',', "
    + ", ".join(f"CASE WHEN {_RESOLVED[t]} IS NULL THEN '{t}' END" for t in DEFAULT_REQUIRED_FIELDS)
    + ") AS missing_required, CASE k % 3 WHEN 0 THEN 'direct_signed_amount' WHEN 1 THEN 'debit_credit_columns' "
    "ELSE 'amount_with_drcr' END AS amount_mode FROM files",
)
def q_resolve(spark, sf_dir):
    out = M.resolve_mapping(_files(spark, sf_dir), _client_profiles(spark))
    m = F.col("mapping")
    return out.select(
        "file_id",
        *[m[t].alias(t) for t in [*_RESOLVED, "amount", "drcr"]],
        F.concat_ws(",", "missing_required").alias("missing_required"),
        M.infer_amount_mode(m)["mode"].alias("amount_mode"),
    )


# name, sheet, required sources; in order. Only the sources count for a match.
_MATCH = [
    ("small", "csv", None, ["科目名称"]),
    ("dated", "csv", None, ["日期", "科目名称"]),
    ("amounts", "csv", None, ["account_name", "amt", "flag"]),
    ("sheet", "excel", "S1", ["account_name"]),
    ("any-sheet", "excel", None, ["account_name"]),
]


def _match_profiles(spark: SparkSession) -> DataFrame:
    items = []
    for i in range(7):
        for name, kind, sheet, sources in _MATCH:
            targets = dict(zip(("ac_caption", "posting_date"), reversed(sources)))
            amount = DirectAmount()
            if "amt" in sources:
                targets, amount = {"ac_caption": sources[0]}, FlaggedAmount("amt", "flag")
            items.append((f"client-{i}", Profile(name, targets, amount, source_type=kind, sheet=sheet)))
    return M.profiles_frame(spark, items)


@register(
    "mapping_match",
    _FILES_SQL
    + """, f AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'excel' ELSE 'csv' END AS kind, 'S' || CAST(k % 3 AS VARCHAR) AS sheet,
  [c FOR c IN [book_date, voucher_no, ac_code, ac_name, summary, debit, credit, direct_amount,
    CASE WHEN k % 3 = 2 THEN 'amt' END, CASE WHEN k % 3 = 2 THEN 'flag' END] IF c IS NOT NULL] AS cols FROM files),
p(name, kind, sheet, req, o) AS (VALUES """
    + ", ".join(
        f"('{n}', '{kind}', {'NULL' if sheet is None else repr(sheet)}, {sources}, {i})"
        for i, (n, kind, sheet, sources) in enumerate(_MATCH)
    )
    + """),
m AS (SELECT k, name, len(req) AS n, row_number() OVER (PARTITION BY k ORDER BY len(req) DESC, o) AS rn
  FROM f JOIN p ON f.kind = p.kind AND (p.kind <> 'excel' OR p.sheet IS NULL OR p.sheet = f.sheet) AND list_has_all(cols, req))
SELECT f.k AS file_id, m.name AS profile_name, CAST(m.n AS INTEGER) AS required_sources
FROM f LEFT JOIN m ON m.k = f.k AND m.rn = 1""",
)
def q_match(spark, sf_dir):
    return M.match_profiles(_files(spark, sf_dir), _match_profiles(spark))


# --- profiles by customer ----------------------------------------------------

_LACKS = {t: p for t, p in zip(MAPPING_TARGETS, (2, 3, 5, 7, 11, 13, 4, 6, 9, 8, 10, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22))}


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer c has a mapping for target t unless c % _LACKS[t] is 0."""
    c = F.col("c_custkey")
    entry = lambda t: F.when(
        c % _LACKS[t] != 0, F.struct(F.lit(t).alias("key"), F.concat(F.lit(f"{t}-"), (c % 10).cast("string")).alias("value"))
    )
    entries = F.filter(F.array(*[entry(t) for t in MAPPING_TARGETS]), lambda e: e.isNotNull())
    mode = c % 4
    text = F.lit(None).cast("string")
    some = F.when(c % 3 != 0, F.lit("x")).otherwise(F.lit(""))
    values = {
        "client_name": F.col("c_nationkey").cast("string"),
        "profile_name": F.concat(F.lit("p"), c.cast("string")),
        "profile_order": F.lit(0),
        "source_type": F.lit("csv"),
        "source_sheet": text,
        "required_field": F.when(c % 5 == 0, F.array(F.lit("lc_amount"), F.lit("no-such"))).otherwise(
            F.array().cast("array<string>")
        ),
        "mapping": F.map_from_entries(entries),
        "amount_mode": F.when(mode == 0, "direct_signed_amount").when(mode == 1, "amount_with_drcr")
        .when(mode == 2, "debit_credit_columns").otherwise("other"),
        "direct_amount_field": some, "amount_field": some, "debit_field": some,
        "credit_field": F.when(c % 7 != 0, F.lit("y")), "drcr_field": text,
        "debit_values": F.array(F.lit("D")), "credit_values": F.array(F.lit("C")),
        "field_rules": F.when(c % 2 == 0, F.create_map(F.lit("voucher_id"), F.lit("v_"))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
        "empty_tokens": F.array(F.lit("-")), "date_dayfirst": F.lit(False), "amount_remove_commas": F.lit(True),
    }
    customer = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    customer = fx.spread(customer, "c_custkey")  # small rows, of which each makes a large one
    return customer.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in M.PROFILE_SCHEMA.fields])


def _has_sql(target: str) -> str:
    return f"(c % {_LACKS[target]} <> 0)" if target in _LACKS else "false"


def _missing_sql(targets: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_has_sql(t)} THEN '{t}' END" for t in targets) + ")"


_PROFILES_SQL = "WITH p AS (SELECT c_custkey AS c, CAST(c_nationkey AS VARCHAR) AS client_name, 'p' || CAST(c_custkey AS VARCHAR) AS profile_name FROM customer)\n"


@register(
    "profile_validate",
    _PROFILES_SQL
    + f"""SELECT client_name, profile_name,
  CASE WHEN c % 5 = 0 THEN {_missing_sql(['lc_amount', 'no-such'])} ELSE {_missing_sql(DEFAULT_REQUIRED_FIELDS)} END AS required_missing,
  CASE c % 4
    WHEN 0 THEN CASE WHEN c % 3 = 0 AND NOT {_has_sql('rc_amount')} THEN 'direct_amount_field' ELSE '' END
    WHEN 1 THEN concat_ws(',', CASE WHEN c % 3 = 0 THEN 'amount_field' END, CASE WHEN NOT {_has_sql('drcr')} THEN 'drcr_field' END)
    WHEN 2 THEN concat_ws(',', CASE WHEN c % 3 = 0 THEN 'debit_field' END, CASE WHEN c % 7 = 0 THEN 'credit_field' END)
    ELSE 'amount_rules.mode' END AS amount_missing
FROM p""",
)
def q_validate(spark, sf_dir):
    out = M.validate_profiles(_profiles(spark, sf_dir))
    return out.select(
        "client_name", "profile_name", *[F.concat_ws(",", c).alias(c) for c in ("required_missing", "amount_missing")]
    )


@register(
    "profile_upsert",
    _PROFILES_SQL
    + """SELECT client_name, profile_name,
  CAST(row_number() OVER (PARTITION BY client_name ORDER BY CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END, profile_name) - 1 AS INTEGER) AS profile_order,
  CASE WHEN c % 3 = 0 AND c % 2 <> 0 THEN 'description' WHEN c % 5 = 0 THEN 'lc_amount,no-such'
       WHEN c % 3 = 0 AND c % 2 = 0 THEN '' ELSE '' END AS required_field,
  CASE WHEN c % 2 = 0 THEN 'v_' END AS voucher_prefix,
  CASE WHEN c % 3 = 0 THEN 'new' ELSE 'csv' END AS source_type
FROM p""",
)
def q_upsert(spark, sf_dir):
    old = _profiles(spark, sf_dir)
    again = old.filter(F.substring("profile_name", 2, 20).cast("long") % 3 == 0)
    new = again.withColumns(
        {
            "required_field": F.array(F.lit("description")),
            "field_rules": F.create_map().cast("map<string,string>"),
            "source_type": F.lit("new"),
        }
    )
    out = M.upsert_profiles(old, new)
    return out.select(
        "client_name",
        "profile_name",
        "profile_order",
        F.concat_ws(",", "required_field").alias("required_field"),
        F.col("field_rules")["voucher_id"].alias("voucher_prefix"),
        "source_type",
    )


_TARGET_LIST = "[" + ", ".join(f"'{t}'" for t in MAPPING_TARGETS) + "]"
_LACKS_LIST = "[" + ", ".join(str(_LACKS[t]) for t in MAPPING_TARGETS) + "]"


@register(
    "mapping_report",
    _PROFILES_SQL
    + f""", t AS (SELECT p.*, unnest(range(1, {len(MAPPING_TARGETS) + 1})) AS i FROM p),
s AS (SELECT client_name, profile_name, CAST(i - 1 AS INTEGER) AS pos, ({_TARGET_LIST})[i] AS target_field,
  CASE WHEN c % ({_LACKS_LIST})[i] <> 0 THEN ({_TARGET_LIST})[i] || '-' || CAST(c % 10 AS VARCHAR) ELSE '' END AS source_field FROM t)
SELECT *, CASE WHEN source_field <> '' THEN 'direct_mapping' ELSE 'unmapped' END AS rule,
  CASE WHEN source_field <> '' THEN 'success' ELSE 'optional_blank' END AS status FROM s""",
)
def q_report(spark, sf_dir):
    return M.mapping_report(_profiles(spark, sf_dir))
