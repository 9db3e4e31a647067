"""Names, lists, thresholds and rule texts that results depend on.

Everything here is a value, not logic. The order of every list is part of the
value: imputation rules run in list order, mapping entries keep file order.
"""

from __future__ import annotations

# Fixed value: raw column name, descriptive name (file order, 89 entries).
PARTICIPANT_MAPPING_CSV = """\
column_name,description
id,unique_id
var_0,balance_1
var_1,balance_2
var_2,credit_limit_1
var_3,credit_limit_2
var_4,balance_3
pin,pin code
var_5,credit_limit_3
var_6,loan_amt_1
var_7,loan_amt_2
var_8,business_balance
var_9,total_emi_1
var_10,active_credit_limit_1
var_11,credit_limit_recent_1
var_12,credit_limit_4
var_13,loan_amt_large_tenure
var_14,primary_loan_amt
var_15,total_inquiries_1
var_16,total_inquiries_2
var_17,total_emi_2
var_18,balance_4
var_19,balance_5
var_20,loan_amt_3
var_21,balance_6
var_22,credit_limit_5
var_23,credit_limit_6
var_24,loan_amt_recent
var_25,total_inquiries_recent
var_26,credit_limit_7
var_27,credit_limit_8
age,age
var_28,credit_limit_9
var_29,credit_limit_10
var_30,balance_7
var_31,loan_amt_4
var_32,credit_score
var_33,credit_limit_11
var_34,balance_8
var_35,balance_9
var_36,loan_amt_5
var_37,repayment_1
var_38,balance_10
var_39,loan_amt_6
var_40,closed_loan
var_41,total_emi_3
var_42,loan_amt_7
var_43,total_emi_4
var_44,credit_limit_12
var_45,total_inquires_3
var_46,total_emi_5
var_47,credit_limit_13
var_48,repayment_2
var_49,repayment_3
var_50,repayment_4
var_51,total_emi_6
var_52,repayment_5
var_53,total_loans_1
var_54,closed_total_loans
var_55,repayment_6
var_56,total_emi_7
var_57,total_loans_2
var_58,total_inquires_4
var_59,balance_11
var_60,total_loans_2
var_61,total_inquires_5
var_62,total_loan_recent
var_63,total_loans_3
var_64,total_loans_4
var_65,loan_amt_8
var_66,total_loans_5
var_67,repayment_7
var_68,balance_12
var_69,repayment_8
var_70,repayment_9
var_71,total_inquires_6
var_72,loan_amt_9
var_73,repayment_10
var_74,score_comments
var_75,score_type
gender,gender
marital_status,marital_status
city,city
state,state
residence_ownership,residence_ownership
target_income,target
device_model,device_model
device_category,device_category
platform,platform
device_manufacturer,device_manufacturer
"""

# Fixed value: fallback mapping used when no mapping file is available.
DEFAULT_MAPPING = {
    "var_0": "balance_1",
    "var_1": "balance_2",
    "var_2": "credit_limit_1",
    "age": "age",
    "gender": "gender",
    "marital_status": "marital_status",
    "city": "city",
    "state": "state",
    "residence_ownership": "residence_ownership",
}

# Fixed value: columns that carry no predictive content.
IDENTIFIER_COLUMNS = [
    "unique_id", "pin code", "score_comments", "score_type",
    "device_model", "device_category", "platform", "device_manufacturer",
]
# Fixed value: text columns kept out of the encoded features.
ID_LIKE_TEXT_COLUMNS = ["unique_id", "score_comments", "pin code"]

TEXT_COLUMNS = [
    "pin code", "score_comments", "score_type", "gender", "marital_status",
    "city", "state", "residence_ownership", "device_model", "device_category",
    "platform", "device_manufacturer",
]

# Fixed value: pin code -> city, state.
PIN_PLACES = [
    ("400001", "Mumbai", "Maharashtra"),
    ("560100", "Bangalore", "Karnataka"),
    ("110091", "Delhi", "Delhi"),
    ("700001", "Kolkata", "West Bengal"),
    ("600001", "Chennai", "Tamil Nadu"),
]

# Fixed value: the stamp of an imputation run and the fill for missing dates
# (21:11 on 2025-06-14 at the local-mean offset +05:53, in UTC).
IMPUTATION_TIMESTAMP_UTC = "2025-06-14 15:18:00"

# Numeric columns filled by rule, in rule order.
IMPUTED_NUMERIC = [
    "age", "var_0", "var_1", "var_2", "var_3", "var_4", "var_5", "var_6", "var_7", "var_8",
    "var_9", "var_10", "var_14", "var_15", "var_16", "var_17", "var_18", "var_19", "var_20",
    "var_21", "var_22", "var_24", "var_25", "var_26", "var_27", "var_30", "var_31", "var_32",
    "var_35", "var_36", "var_37", "var_38", "var_40", "var_41", "var_42", "var_43", "var_44",
    "var_47", "var_48", "var_49", "var_50", "var_51", "var_52", "var_53", "var_54", "var_55",
    "var_56", "var_57", "var_58", "var_59", "var_60", "var_61", "var_62", "var_63", "var_64",
    "var_65", "var_66", "var_68", "var_69", "var_70", "var_71", "var_72", "var_73",
]

# Text columns filled by rule, in rule order.
IMPUTED_TEXT = [
    "gender", "city", "state", "residence_ownership", "device_model",
    "device_category", "platform", "device_manufacturer", "marital_status",
    "var_74", "var_75",
]

IMPUTED_DATES = ["last_updated", "transaction_date"]

# Ids filled with 0, by the meaning their rule gives them.
ZERO_FILLED_IDS = {
    "balance": [
        "var_18", "var_22", "var_27", "var_36", "var_49", "var_54", "var_60", "var_68",
    ],
    "credit_limit": [
        "var_5", "var_10", "var_14", "var_19", "var_25", "var_30", "var_38", "var_43", "var_47",
        "var_55", "var_62",
    ],
    "loan_amt": [
        "var_20", "var_24", "var_31", "var_41", "var_50", "var_61", "var_72",
    ],
    "total_emi": [
        "var_17", "var_26", "var_34", "var_42", "var_51", "var_56",
    ],
    "total_inquiries": [
        "var_16", "var_21", "var_28", "var_35", "var_71",
    ],
}
# Ids copied from the first repayment / first loan count, and the
# ids counted when the loan count itself is missing.
REPAYMENT_IDS = [
    "var_44", "var_48", "var_52", "var_58", "var_59", "var_63", "var_64", "var_69", "var_73",
]
LOAN_COUNT_IDS = [
    "var_57", "var_65", "var_66", "var_70",
]
LOAN_AMOUNT_IDS = [
    "var_6", "var_7", "var_20", "var_24", "var_31", "var_41", "var_50", "var_61", "var_72",
]

# Column, fill text, columns the text needs, fill when they are
# absent. {stat:column} stands for a statistic of the column's present values.
NUMERIC_FILL_RULES = [
    ("age", "case when target_income > 50000 then {mean:age} else 30 end", ["target_income"], "30"),
    ("var_0", "target_income * 0.125", ["target_income"], "{median:var_0}"),
    ("var_1", "var_0 * 0.4", ["var_0"], "0"),
    ("var_2", "target_income * 4", ["target_income"], "{median:var_2}"),
    ("var_3", "var_2 * 0.5", ["var_2"], "0"),
    ("var_4",
     "case when target_income > {p75:target_income} then {median:var_4} else 0 end",
     ["target_income"], "0"),
    ("var_6", "target_income * 2.5 * 12", ["target_income"], "0"),
    ("var_7", "var_6 * 0.4", ["var_6"], "0"),
    ("var_8", "case when target_income > 60000 then target_income * 2.5 else 0 end",
     ["target_income"], "0"),
    ("var_9", "var_6 * 0.008", ["target_income", "var_6"], "0"),
    ("var_15", "case when age < 35 then 3 else 1 end", ["age"], "1"),
    ("var_32", "case when target_income > 50000 and age > 30 then 750 else 675 end",
     ["target_income", "age"], "675"),
    ("var_37", "case when var_32 > 700 then 1 else 0 end", ["var_32"], "0"),
    ("var_40", "case when age > 40 then var_53 * 0.5 else 0 end", ["var_53", "age"], "0"),
]

TEXT_FILL_RULES = [
    ("gender", "case when target_income > 40000 then 'Male' else {mode:gender} end",
     ["target_income"], "{mode:gender}"),
    ("residence_ownership",
     "case when target_income > 60000 and age > 35 then 'SELF-OWNED' else 'RENTED' end",
     ["target_income", "age"], "'RENTED'"),
    ("device_model",
     "case when target_income > 50000 then 'iPhone' else 'Generic Android' end",
     ["target_income"], "'Generic Android'"),
    ("device_category",
     "case when lower(device_model) like '%iphone%' or lower(device_model) like '%samsung%' "
     "then 'SMART PHONE' else 'FEATURE PHONE' end", ["device_model"], "'SMART PHONE'"),
    ("platform",
     "case when lower(device_model) like '%iphone%' then 'IOS' else 'Android' end",
     ["device_model"], "'Android'"),
    ("device_manufacturer",
     "case when lower(device_model) like '%iphone%' then 'Apple' else 'Samsung' end",
     ["device_model"], "'Samsung'"),
    ("marital_status", "case when age > 28 then 'Married' else 'Single' end", ["age"], "'Single'"),
    ("var_74", "case when var_32 > 700 then 'Low Risk' else 'Medium Risk' end",
     ["var_32"], "'Medium Risk'"),
    ("var_75", "'Primary Score'", [], "'Primary Score'"),
]

# The text standing in for a column without any present value.
NO_MODE = "Unknown"

# Family patterns (regular expression, prefix, substring forms).
FAMILY_REGEX = {
    "credit_limit": r"credit_limit_\d+",
    "balance": r"balance_\d+",
    "total_emi": r"total_emi_\d+",
    "inquiries": r"total_inquiries_\d+|total_inquires_\d+",
    "loan_amt": r"loan_amt_\d+",
    "repayment": r"repayment_\d+",
}
FAMILY_PREFIX = {
    "credit_limit": ("credit_limit_",),
    "balance": ("balance_",),
    "total_emi": ("total_emi_",),
    "inquiries": ("total_inquiries_", "total_inquires_"),
    "loan_amt": ("loan_amt_",),
    "repayment": ("repayment_",),
}
FAMILY_SUBSTRING = {
    "credit_limit": "credit_limit",
    "balance": "balance",
    "total_emi": "total_emi",
    "inquiries": "inquiries",
    "loan_amt": "loan_amt",
    "repayment": "repayment",
}
# Names of the sum and mean of each family.
OVERALL_NAMES = {
    "credit_limit": ("total_credit_limit_overall", "avg_credit_limit_overall"),
    "balance": ("total_balance_overall", "avg_balance_overall"),
    "total_emi": ("total_emi_overall", "avg_emi_overall"),
    "inquiries": ("total_inquiries_overall", "avg_inquiries_overall"),
    "loan_amt": ("total_loan_amount_overall", "avg_loan_amount_overall"),
}

RATIO_EPSILON = 1e-6

# Left-closed age bands.
AGE_BANDS = [(0, 25, "<25"), (25, 35, "25-34"), (35, 45, "35-44"), (45, 55, "45-54"), (55, None, "55+")]

# Columns that also get a log1p copy.
LOG_COLUMNS = ["total_loan_amount", "total_credit_limit", "total_emi", "income"]

REPAYMENT_OK_INCOME = 50000

# Thresholds of the screening reports.
SPARSE_FRACTION = 0.5
SCREEN_MISSING = 0.60
SCREEN_CORRELATION = 0.005

# Target encoding.
TARGET_ENCODED = ["city", "state", "marital_status", "gender", "residence_ownership", "age_bin"]
TARGET_MIN_SAMPLES = 20
TARGET_SMOOTHING = 0.2

# Request checks.
REQUEST_RANGES = {
    "age": (18, 100),
    "credit_score": (300, 900),
    "total_loan_amount": (0, None),
    "total_credit_limit": (0, None),
    "total_emi": (0, None),
    "threshold": (0, 1),
}
REQUEST_ENUMS = {
    "gender": ["MALE", "FEMALE", "OTHER"],
    "marital_status": ["SINGLE", "MARRIED", "DIVORCED", "WIDOWED"],
    "residence_ownership": ["SELF-OWNED", "RENTED", "PARENTAL", "COMPANY-PROVIDED"],
}
REQUIRED_FIELDS = ["age", "gender", "marital_status", "city", "state", "residence_ownership"]

# Model settings (trees, depth, learning rate, subsample).
BOOSTED_TREES = {"trees": 200, "depth": 6, "learning_rate": 0.05, "subsample": 0.8, "min_child": 2}
RIGOROUS_TREES = {"trees": 200, "depth": 5, "learning_rate": 0.1}
FOREST = {"trees": 100, "depth": 10}
FOREST_FEATURE_SHARE = 0.8
# The share of columns a boosted tree of the two-target fit may use. Its least split gain, a sum
# over rows of 0.1, has no counterpart here: a gain per row that small never stops a split.
BOOSTED_FEATURE_SHARE = 0.8
TUNING_GRID = {
    "depth": [3, 5, 7],
    "learning_rate": [0.01, 0.05, 0.1],
    "trees": [100, 200],
    "min_child": [1, 3, 5],
    "subsample": [0.8, 0.9, 1.0],
}
RANDOM_SEARCH_SPACE = {
    "trees": (100, 500, 100),
    "learning_rate": (0.01, 0.1),
    "depth": (3, 6),
}
RANDOM_SEARCH_TRIALS = 10
VOTING_WEIGHTS = {"boosted": 0.4, "boosted_validated": 0.4, "forest": 0.2}
SPLIT_SEED = 42
BATCH_ROWS = 100
DEFAULT_THRESHOLD = 0.5

# Eligibility bands of a 0-1 score (lower bound exclusive for the first).
ELIGIBILITY_HIGH = 0.8
ELIGIBILITY_LOW = 0.6

# External area and behaviour columns a join can add.
EXTERNAL_COLUMNS = [
    "night_light_intensity", "market_density_score", "local_literacy_rate",
    "upi_transaction_frequency", "mobile_recharge_frequency", "bill_payment_consistency",
    "ecommerce_purchase_frequency", "digital_service_subscriptions",
    "app_diversity_count", "digital_literacy_score",
]
