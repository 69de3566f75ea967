"""The plan contract: types, defaults and whitelists."""

from __future__ import annotations

# --- fixed values ---------------------------------------------------------------
NUMERIC_STRATEGIES = ["median", "mean"]
CATEGORICAL_STRATEGIES = ["most_frequent", "constant"]
SCALING_STRATEGIES = ["standard", "minmax", "none"]
TASKS = ["classification", "regression"]
DEFAULT_FILL = "Unknown"
DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42
DEFAULT_SMOTE_REASON = "Safe default: disabled unless class imbalance is explicitly confirmed"
WEAK_STATUSES = ["fallback_no_model_output", "fallback_parse_failed", "regex_critical_fields"]
ONE_HOT_LEVELS = 15
# --------------------------------------------------------------------------------

LISTS = "array<string>"

#: A proposed plan. Arrays stay NULL when the proposal does not give them.
PREPROCESSING = (
    f"struct<drop_columns:{LISTS},"
    f"imputation:struct<numeric_strategy:string,numeric_columns:{LISTS},"
    f"categorical_strategy:string,categorical_columns:{LISTS},constant_value:string>,"
    f"encoding:struct<one_hot_columns:{LISTS},label_encoding_columns:{LISTS}>,"
    f"scaling:struct<strategy:string,columns:{LISTS}>,log_transform:{LISTS}>"
)
SPLIT = "struct<test_size:double,random_state:int,stratify:boolean>"
SMOTE = "struct<enabled:boolean,reason:string>"
FLAT = (
    f"target_column:string,task_type:string,preprocessing:{PREPROCESSING},"
    f"split_strategy:{SPLIT},smote:{SMOTE}"
)
MODEL_OUTPUT = f"struct<{FLAT},preprocessing_plan:struct<{FLAT}>>"
PROPOSAL = f"struct<{FLAT},encoding_given:boolean>"
