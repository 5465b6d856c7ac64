"""Raw table schemas. Ids and codes are text, money is decimal(18,2)."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
_KINDS = {"s": T.StringType(), "d": T.DateType(), "t": T.TimestampType(), "m": MONEY, "i": T.IntegerType(), "f": T.DoubleType(), "b": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """``name:kind`` pairs to a schema; kind is s, d, t, m, i, f or b."""
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _KINDS[kind]))
    return T.StructType(fields)


SCHEMAS = {
    "dictionary": _schema(
        "record_id:s field_name:s field_code:s field_description:s parent_field_name:s parent_field_code:s update_date:d"
    ),
    "currency": _schema("base:s quote:s rate:f rate_date:d update_time:t"),
    "transaction": _schema(
        "transaction_id:s customer_id:s account_id:s contract_id:s department_id:s code:s dbcr:s currency:s transaction_time:t "
        "value_date:d amount:m fee_amount:m commission_amount:m reversal_flag:s success:s channel_name:s"
    ),
    "portfolio_manager": _schema(
        "portfolio_manager_id:s company_sublevel1_id:s company_sublevel2_id:s company_sublevel3_id:s department_id:s "
        "department_sublevel1_id:s department_sublevel2_id:s department_sublevel3_id:s manager_name:s title_name:s status_name:s "
        "update_date:d start_date:d end_date:d"
    ),
    "customer": _schema(
        "customer_id:s update_date:d creation_date:d department_id:s portfolio_manager_id:s area_code:s gender_code:s sector_code:s "
        "subsector_code:s marital_status:s type_code:s status:s birth_year:i birth_month:i"
    ),
    "account": _schema(
        "account_id:s customer_id:s department_id:s account_code:s status:s currency:s account_type:s update_date:d start_date:d "
        "end_date:d maturity_date:d interest_rate:f overdraft_amount:m"
    ),
    "account_balance": _schema(
        "account_id:s customer_id:s account_code:s currency:s balance_date:d capital_balance:m interest_balance:m "
        "unpaid_fee_balance:m available_balance:m"
    ),
    "loan": _schema(
        "loan_id:s customer_id:s department_id:s portfolio_manager_id:s product_code:s currency:s payment_type:s loan_type:s status:s "
        "repayment_account_id:s update_date:d start_date:d disbursement_date:d end_date:d maturity_date:d capital_disbursed_amount:m "
        "net_disbursed_amount:m cycle:i instalments:i interest_rate:f restructured:b restructured_covid:b"
    ),
    "loan_balance": _schema(
        "loan_id:s balance_date:d customer_id:s product_code:s status:s currency:s principal_outstanding:m principal_overdue:m "
        "interest_outstanding:m interest_overdue:m penalty_overdue:m days_overdue:i"
    ),
    "schedule": _schema(
        "customer_id:s contract_id:s currency:s status:s instalment:i due_date:d update_date:d total_due:m capital_due:m interest_due:m"
    ),
    "event": _schema(
        "customer_id:s contract_id:s instalment:i transaction_id:s event_code:s currency:s due_date:d event_time:t total_paid:m "
        "capital_paid:m interest_paid:m penalty_paid:m capital_remaining:m interest_remaining:m early_termination_flag:s"
    ),
    "loan_application": _schema(
        "application_id:s customer_id:s portfolio_manager_id:s stage_code:s loan_id:s purpose_code:s product_code:s end_code:s "
        "currency:s department_id:s update_time:t start_date:d end_date:d requested_amount:m reviewed_amount:m approved_amount:m"
    ),
    "core_transaction": _schema("trnid:s acc:s trncode:s trndate:s valuedate:s trnamt:s priamt:s intamt:s penamt:s"),
    "written_off": _schema(
        "loan_id:s customer_id:s portfolio_manager_id:s wo_date:s update_date:s principal_written_off:m interests_written_off:m "
        "penalty_written_off:m principal_due:m interests_due:m penalty_due:m"
    ),
    "activity_summary": _schema("account_id:s update_date:s code:s dbcr:s tt_number:i tt_volume:m currency:s"),
}
