"""DuckDB text of the same computations, used as the correctness oracle.

The adapter text mirrors ``sources.journal_fixture.raw_journal``; the
cleaning text states the ledger rules in plain SQL for each fixture profile.
"""

from __future__ import annotations

from ..schema import DEFAULT_CREDIT_VALUES, DEFAULT_DEBIT_VALUES

RAW_JOURNAL = """
raw_base AS (
  SELECT
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_row,
    CASE WHEN l_orderkey % 89 = 0 THEN 'bad-date'
         ELSE substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)), 1, 10) END AS src_date,
    CASE WHEN l_orderkey % 97 = 0 THEN '  ' ELSE CAST(l_orderkey AS VARCHAR(20)) END AS src_voucher,
    CASE WHEN l_partkey % 101 = 0 THEN '' ELSE CAST(1000 + l_suppkey % 50 AS VARCHAR(20)) END AS src_account,
    CASE WHEN l_partkey % 103 = 0 THEN NULL ELSE p_type END AS src_account_name,
    CASE WHEN l_linenumber = 7 THEN '' ELSE p_name END AS src_text,
    CASE WHEN l_orderkey % 83 = 0 THEN 'n/a'
         ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS src_amount,
    CASE WHEN l_returnflag = 'A' THEN 'S' WHEN l_returnflag = 'R' THEN 'H'
         WHEN l_linestatus = 'O' THEN '借' ELSE '?' END AS src_drcr,
    'client-' || CAST(l_suppkey % 4 AS VARCHAR) AS src_client,
    CAST(year(l_shipdate) AS INTEGER) AS src_year,
    l_orderkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
raw_journal AS (
  SELECT *,
    CASE WHEN src_drcr = 'H' THEN '-' || src_amount ELSE src_amount END AS src_signed,
    CASE WHEN src_drcr IN ('S', '借') THEN src_amount END AS src_debit,
    CASE WHEN src_drcr = 'H' THEN src_amount END AS src_credit
  FROM raw_base
)"""


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def _prefixed(expr: str, prefix: str | None) -> str:
    if not prefix:
        return expr
    return f"CASE WHEN NULLIF(TRIM({expr}), '') IS NULL THEN NULL ELSE {_lit(prefix)} || TRIM({expr}) END"


def _amount(kind: str) -> str:
    dec = "DECIMAL(18,2)"
    if kind == "flag":
        a = f"ABS(TRY_CAST(src_amount AS {dec}))"
        return (
            f"CASE WHEN src_drcr IN {_in(DEFAULT_DEBIT_VALUES)} THEN {a} "
            f"WHEN src_drcr IN {_in(DEFAULT_CREDIT_VALUES)} THEN -{a} END"
        )
    if kind == "direct":
        return f"TRY_CAST(src_signed AS {dec})"
    d = f"COALESCE(ABS(TRY_CAST(src_debit AS {dec})), 0)"
    c = f"COALESCE(ABS(TRY_CAST(src_credit AS {dec})), 0)"
    return f"CAST({d} - {c} AS {dec})"


PREFIXES = {
    "flag": {"voucher_id": "v_"},
    "direct": {},
    "debit_credit": {"ac_code": "ac_", "description": "d_"},
}


def flagged_cte(kind: str, client: str, year: str, batch: str, source_file: str = "raw_journal", batch_sql: str | None = None) -> str:
    """CTE ``flagged``: ledger columns + source_row + invalid flag + message.

    ``client`` and ``year`` are SQL expressions (literals or src columns).
    """
    p = PREFIXES[kind]
    drcr = "src_drcr" if kind == "flag" else "CAST(NULL AS VARCHAR)"
    return f"""
mapped AS (
  SELECT
    source_row,
    TRY_CAST(src_date AS DATE) AS posting_date,
    {_prefixed('src_voucher', p.get('voucher_id'))} AS voucher_id,
    CAST(NULL AS VARCHAR) AS voucher_header,
    CAST(NULL AS VARCHAR) AS company_id,
    {_prefixed('src_account', p.get('ac_code'))} AS ac_code,
    src_account_name AS ac_caption,
    {drcr} AS drcr,
    {_amount(kind)} AS rc_amount,
    CAST(NULL AS DECIMAL(18,2)) AS lc_amount,
    CAST(NULL AS VARCHAR) AS vendor_id,
    CAST(NULL AS VARCHAR) AS vendor_name,
    CAST(NULL AS VARCHAR) AS customer_id,
    CAST(NULL AS VARCHAR) AS customer_name,
    {_prefixed('src_text', p.get('description'))} AS description,
    CAST({client} AS VARCHAR) AS client_name,
    CAST({year} AS INTEGER) AS fiscal_year,
    {_lit(source_file)} AS source_file,
    {batch_sql or _lit(batch)} AS import_batch_id,
    l_orderkey, src_year
  FROM raw_journal
),
flagged AS (
  SELECT *,
    (NULLIF(TRIM(voucher_id), '') IS NULL OR NULLIF(TRIM(ac_code), '') IS NULL
     OR NULLIF(TRIM(ac_caption), '') IS NULL OR rc_amount IS NULL) AS invalid
  FROM mapped
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


LEDGER_OUT = (
    "posting_date, voucher_id, voucher_header, company_id, ac_code, ac_caption, drcr, rc_amount, "
    "lc_amount, vendor_id, vendor_name, customer_id, customer_name, description, client_name, "
    "fiscal_year, source_file, import_batch_id"
)
