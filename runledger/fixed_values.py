"""Names, thresholds and lists that results must agree on."""

# Run states of the timeline.
SUCCEEDED = "SUCCEEDED"
SUCCESS_STATES = ("SUCCEEDED", "SUCCESS")
BAD_STATES = ("FAILED", "ERROR", "TIMED_OUT")
RUNNING = "RUNNING"

# Display class of a state or verdict, compared in upper case.
STATUS_CLASSES = {
    "success": ("SUCCESS", "SUCCEEDED", "COMPLETED", "HEALTHY", "COMPLIANT"),
    "error": ("FAILED", "ERROR", "CRITICAL", "NON_COMPLIANT"),
    "warning": ("RUNNING", "PENDING", "IN_PROGRESS", "WARNING", "AT_RISK"),
}

# SKU categories, first match wins: every group of alternatives must have a hit.
SKU_CATEGORIES = (
    ("Serverless SQL", (("SERVERLESS",), ("SQL",))),
    ("Serverless Jobs", (("SERVERLESS",), ("JOB",))),
    ("Serverless Compute", (("SERVERLESS",), ("ALL_PURPOSE",))),
    ("Serverless Database", (("SERVERLESS",), ("DATABASE",))),
    ("Model Serving", (("SERVERLESS",), ("INFERENCE",))),
    ("Model Serving", (("MODEL_SERVING", "INFERENCE"),)),
    ("SQL Pro", (("SQL",), ("PRO",))),
    ("SQL Warehouse", (("SQL",),)),
    ("Delta Live Tables", (("DLT",),)),
    ("All-Purpose Compute", (("ALL_PURPOSE",),)),
    ("Jobs Compute", (("JOB",),)),
    ("Lakebase/OLTP", (("OLTP", "LAKEBASE", "DATABASE"),)),
)
SKU_OTHER = "Other"

# Prices and products.
DEFAULT_UNIT_PRICE = "0.15"
ATTRIBUTED_PRODUCTS = ("JOBS", "INTERACTIVE", "WORKFLOWS")

# Labels of missing group keys.
UNKNOWN_RUN_TYPE = "UNKNOWN"
UNKNOWN_IDENTITY = "Unknown"
UNTAGGED_PROJECT = "Untagged"
UNKNOWN_DEPARTMENT = "Unknown"
DIRECT_EXECUTION = "Direct Execution"
MATCHED, UNMATCHED = "MATCHED", "UNMATCHED"

# Tag policies that a new installation starts with.
POLICY_SEED = (
    ("project_code", "Project Code", "Project identifier for cost attribution", "cost", True, None, None, r"^[A-Z]{2,5}-[0-9]{3,6}$", True),
    ("cost_center", "Cost Center", "Financial cost center code", "cost", True, None, None, r"^CC[0-9]{4,8}$", True),
    ("department", "Department", "Organizational department", "cost", True,
     ["Engineering", "Data Science", "Analytics", "Finance", "Operations", "Marketing", "Healthcare", "Research"], None, None, True),
    ("environment", "Environment", "Deployment environment", "operations", True, ["dev", "test", "staging", "prod"], "dev", None, True),
    ("business_unit", "Business Unit", "Business unit name", "cost", False, None, None, None, True),
    ("application_name", "Application Name", "Application or service name", "operations", False, None, None, None, True),
    ("owner_email", "Owner Email", "Responsible team or person email", "operations", False, None, None,
     r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", True),
)

# Answers when no policy table exists.
FALLBACK_POLICIES = (
    ("project_code", "Project Code", None),
    ("department", "Department", None),
    ("environment", "Environment", "dev"),
    ("cost_center", "Cost Center", None),
)
FALLBACK_REQUIRED = ("project_code", "cost_center", "department", "environment")
FALLBACK_DEFAULTS = (("environment", "dev"),)
DEFAULT_ENVIRONMENT = "dev"
