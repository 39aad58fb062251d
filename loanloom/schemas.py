"""Table schemas, label domains and other fixed values of the lending data model."""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOMER = "CUSTOMER_ID"
RECORD = "CREDIT_RECORD_ID"
LOAN = "PRIOR_LOAN_ID"
REQUEST = "REQUEST_ID"
UNKNOWN = "Unknown"
MISSING = "Missing"

# Column names and types of the seven raw tables, in table order.
TABLE_COLUMNS = {
    "customer_profile": """
        CUSTOMER_ID bigint, TARGET bigint, LOAN_CONTRACT_TYPE string, GENDER_CODE string,
        OWNS_CAR string, OWNS_PROPERTY string, NUM_CHILDREN bigint, MONTHLY_INCOME double,
        LOAN_AMOUNT double, LOAN_TERM_MONTHS bigint, LOAN_ANNUITY double,
        PURCHASED_GOODS_VALUE double, ACCOMPANIED_BY string, INCOME_SOURCE_TYPE string,
        EDUCATION_LEVEL string, FAMILY_STATUS string, HOUSING_TYPE string,
        REGION_POPULATION_RATIO double, AGE_DAYS bigint, EMPLOYMENT_DURATION_DAYS bigint,
        DAYS_SINCE_REGISTRATION double, DAYS_SINCE_ID_ISSUE bigint, HAS_MOBILE string,
        HAS_WORK_PHONE string, HAS_SECONDARY_PHONE string, MOBILE_ACTIVE string,
        HAS_LANDLINE_PHONE string, HAS_EMAIL string, OCCUPATION_TYPE string,
        NUM_FAMILY_MEMBERS bigint, REGION_SCORE bigint, REGION_CITY_SCORE bigint,
        APPLICATION_DAY_OF_WEEK string, APPLICATION_HOUR bigint,
        RESIDES_IN_REGISTERED_REGION string, WORKS_IN_REGISTERED_REGION string,
        SAME_REGION_WORK_LIVE string, RESIDES_IN_REGISTERED_CITY string,
        WORKS_IN_REGISTERED_CITY string, SAME_CITY_WORK_LIVE string, EMPLOYER_CATEGORY string,
        EXTERNAL_CREDIT_SCORE double, BUILD_YEAR_AVG double, MAX_FLOORS_AVG double,
        BUILD_YEAR_MODE double, MAX_FLOORS_MODE double, BUILD_YEAR_MEDIAN double,
        MAX_FLOORS_MEDIAN double, PROPERTY_TOTAL_AREA double,
        DAYS_SINCE_LAST_PHONE_CHANGE bigint""",
    "credit_summary": """
        CUSTOMER_ID bigint, CREDIT_RECORD_ID bigint, CREDIT_STATUS string,
        CURRENCY_TYPE string, DAYS_SINCE_CREDIT_ISSUED bigint, DAYS_OVERDUE bigint,
        DAYS_UNTIL_CREDIT_END double, DAYS_UNTIL_ACTUAL_CREDIT_CLOSED double,
        NUM_CREDIT_EXTENSIONS string, TOTAL_CREDIT_AMOUNT double, OUTSTANDING_DEBT double,
        CREDIT_LIMIT double, OVERDUE_BALANCE double, TYPE_OF_CREDIT string,
        DAYS_SINCE_CREDIT_UPDATE bigint""",
    "credit_timeline": """
        CREDIT_RECORD_ID bigint, TIME_SINCE_ENTRY bigint, ACCOUNT_STATUS string""",
    "card_activity": """
        PRIOR_LOAN_ID bigint, CUSTOMER_ID bigint, TIME_SINCE_ENTRY bigint,
        CURRENT_CARD_BALANCE double, CARD_CREDIT_LIMIT bigint, CASH_WITHDRAWN_ATM double,
        TOTAL_WITHDRAWN_AMOUNT double, WITHDRAWN_OTHER_CHANNELS double, PURCHASES_POS double,
        MINIMUM_PAYMENT_DUE double, CURRENT_PAYMENT double, TOTAL_PAYMENT double,
        PRINCIPAL_DUE double, RECEIVABLE_BALANCE double, TOTAL_RECEIVABLE double,
        ATM_WITHDRAWAL_COUNT bigint, TOTAL_WITHDRAWAL_COUNT bigint,
        OTHER_WITHDRAWAL_COUNT bigint, POS_PURCHASE_COUNT bigint,
        TOTAL_INSTALLMENTS_PAID bigint, CONTRACT_STATUS string, DAYS_PAST_DUE bigint,
        DAYS_PAST_DUE_90 bigint""",
    "cash_pos_records": """
        PRIOR_LOAN_ID bigint, CUSTOMER_ID bigint, TIME_SINCE_ENTRY bigint,
        LOAN_TERM_MONTHS bigint, REMAINING_TERM_MONTHS bigint, CONTRACT_STATUS string,
        DAYS_PAST_DUE bigint, DAYS_PAST_DUE_90 bigint""",
    "installment_records": """
        PRIOR_LOAN_ID bigint, CUSTOMER_ID bigint, INSTALLMENT_PLAN_VERSION bigint,
        INSTALLMENT_SEQUENCE_NUMBER bigint, DAYS_UNTIL_DUE bigint,
        DAYS_BEFORE_ACTUAL_PAYMENT bigint, SCHEDULED_PAYMENT_AMOUNT double,
        ACTUAL_PAYMENT_AMOUNT double""",
    "prior_loan_history": """
        PRIOR_LOAN_ID bigint, CUSTOMER_ID bigint, LOAN_CONTRACT_TYPE string,
        LOAN_ANNUITY double, REQUESTED_LOAN_AMOUNT double, LOAN_AMOUNT double,
        PURCHASED_GOODS_VALUE double, APPLICATION_DAY_OF_WEEK string, APPLICATION_HOUR bigint,
        IS_LAST_APPLICATION_FOR_CONTRACT string, IS_LAST_APPLICATION_OF_DAY string,
        LOAN_PURPOSE_CATEGORY string, CONTRACT_STATUS string, DAYS_SINCE_DECISION bigint,
        PAYMENT_METHOD string, REJECTION_REASON_CODE string, ACCOMPANIED_BY string,
        CLIENT_TYPE string, PORTFOLIO_TYPE string, APPLICATION_CHANNEL string,
        BRANCH_AREA_CODE bigint, PLANNED_NUM_PAYMENTS double, YIELD_CATEGORY string,
        PRODUCT_BUNDLE_TYPE string, DAYS_UNTIL_FIRST_DRAW double,
        DAYS_UNTIL_FIRST_PAYMENT double, DAYS_UNTIL_FINAL_PAYMENT double,
        DAYS_UNTIL_TERMINATION double, IS_INSURED_ON_APPROVAL string""",
}

# The label domain of each category column.
LABELS = {
    "LOAN_CONTRACT_TYPE": ["Loan Type A", "Loan Type B"],
    "GENDER_CODE": ["Alpha", "Beta"],
    "OWNS_CAR": ["Yes", "No"],
    "OWNS_PROPERTY": ["True", "False"],
    "ACCOMPANIED_BY": ["Single", "Partner", "Group"],
    "INCOME_SOURCE_TYPE": ["Income A", "Income B", "Income C", "Income D"],
    "EDUCATION_LEVEL": ["Education X", "Education Y", "Education Z", "Unknown"],
    "FAMILY_STATUS": ["Status A", "Status B", "Status C", "Status D"],
    "HOUSING_TYPE": ["Housing A", "Housing B", "Housing C", "Other"],
    "HAS_MOBILE": ["Cat_0", "Cat_1", "Cat_2"],
    "HAS_WORK_PHONE": ["Cat_0", "Cat_1", "Cat_2"],
    "HAS_SECONDARY_PHONE": ["Cat_0", "Cat_1", "Cat_2"],
    "MOBILE_ACTIVE": ["Cat_0", "Cat_1", "Cat_2"],
    "HAS_LANDLINE_PHONE": ["Cat_0", "Cat_1", "Cat_2"],
    "HAS_EMAIL": ["Cat_0", "Cat_1", "Cat_2"],
    "OCCUPATION_TYPE": ["Job A", "Job B", "Job C", "Job D", "Job E"],
    "APPLICATION_DAY_OF_WEEK": ["Day A", "Day B", "Day C", "Day D", "Day E"],
    "RESIDES_IN_REGISTERED_REGION": ["Y", "N"],
    "WORKS_IN_REGISTERED_REGION": ["Y", "N"],
    "SAME_REGION_WORK_LIVE": ["Y", "N"],
    "RESIDES_IN_REGISTERED_CITY": ["Y", "N"],
    "WORKS_IN_REGISTERED_CITY": ["Y", "N"],
    "SAME_CITY_WORK_LIVE": ["Y", "N"],
    "EMPLOYER_CATEGORY": ["Org X", "Org Y", "Org Z", "Entity M", "Entity N"],
    "CREDIT_STATUS": ["Active", "Repaid", "Written-Off"],
    "CURRENCY_TYPE": ["Currency X", "Currency Y", "Currency Z"],
    "NUM_CREDIT_EXTENSIONS": ["None", "Once", "Multiple"],
    "TYPE_OF_CREDIT": ["Type A", "Type B", "Type C", "Type D"],
    "ACCOUNT_STATUS": ["On Time", "Delayed", "Defaulted"],
    "CONTRACT_STATUS": ["Status A", "Status B", "Status C"],
    "LOAN_PURPOSE_CATEGORY": ["Purpose A", "Purpose B", "Purpose C"],
    "IS_LAST_APPLICATION_FOR_CONTRACT": ["Y", "N"],
    "IS_LAST_APPLICATION_OF_DAY": ["Y", "N"],
    "PAYMENT_METHOD": ["Transfer", "Cash", "Wire"],
    "REJECTION_REASON_CODE": ["Reason X", "Reason Y", "Reason Z"],
    "CLIENT_TYPE": ["Client A", "Client B"],
    "PORTFOLIO_TYPE": ["Portfolio A", "Portfolio B"],
    "APPLICATION_CHANNEL": ["Channel 1", "Channel 2", "Channel 3"],
    "YIELD_CATEGORY": ["Tier 1", "Tier 2", "Tier 3"],
    "PRODUCT_BUNDLE_TYPE": ["Combo A", "Combo B", "Combo C"],
    "IS_INSURED_ON_APPROVAL": ["Y", "N"],
    "LOAN_AGE_GROUP": ["Loan Tier A", "Loan Tier B", "Loan Tier C"],
}

# Plausible ranges (min, max, mean, std) that replace observed ones.
RANGE_OVERRIDES = {
    "MONTHLY_INCOME": (1000, 10000, 4000, 2000),
    "LOAN_AMOUNT": (5000, 150000, 30000, 20000),
    "LOAN_ANNUITY": (200, 5000, 1200, 700),
    "LOAN_TERM_MONTHS": (6, 72, 36, 15),
    "NUM_CHILDREN": (0, 6, 1.5, 1.2),
    "NUM_FAMILY_MEMBERS": (1, 10, 3.5, 1.5),
    "AGE_DAYS": (-25550, -6570, -14600, 3300),
    "EMPLOYMENT_DURATION_DAYS": (-14600, -30, -3650, 2000),
    "APPLICATION_HOUR": (0, 23, 13, 5),
    "MAX_FLOORS_AVG": (1, 30, 5, 4),
    "MAX_FLOORS_MODE": (1, 10, 5, 2),
    "MAX_FLOORS_MEDIAN": (1, 30, 5, 4),
    "PROPERTY_TOTAL_AREA": (30, 300, 90, 50),
    "REGION_SCORE": (-3, 3, 0, 1),
    "EXTERNAL_CREDIT_SCORE": (0.0, 1.0, 0.5, 0.2),
}

# Weights of the rule-based default probability.
RULE_BASE = 0.05
RULE_WEIGHTS = {
    "big_loan": 0.20,
    "long_employed": 0.15,
    "bad_external_score": 0.50,
    "occupation_risk": 0.35,
    "long_term": 0.10,
}
RULE_BOUNDS = (0.01, 0.95)
OCCUPATION_RISK = {"Job A": 2.0, "Job B": 1.0, "Job C": 0.0, "Job D": -1.0, "Job E": -2.0}

# Affordability limit, decision threshold and texts shown to applicants.
DTI_LIMIT = 0.3
DTI_MESSAGE = "DTI ratio too high (%.1f%%). Please choose a lower loan amount."
DECISION_THRESHOLD = 0.5
BAND_HIGH = "High Risk (Default Likely)"
BAND_LOW = "Low Risk (Default Unlikely)"
RAISED_RISK = "increased risk"
REDUCED_RISK = "reduced risk"

CHILD_TABLES = [name for name in TABLE_COLUMNS if name != "customer_profile"]

_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def table_schema(table: str, drop: tuple[str, ...] = ()) -> T.StructType:
    """The declared schema of a raw table; every column is read as nullable."""
    pairs = (item.split() for item in TABLE_COLUMNS[table].split(","))
    return T.StructType(
        [T.StructField(name, _TYPES[kind]) for name, kind in pairs if name not in drop]
    )


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType))
