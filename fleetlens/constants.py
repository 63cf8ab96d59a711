"""Fixed values of the data model, stated as data."""

# GPU speed relative to the 4090, fallback price in $/hour, market names.
GPU_SPEED = {"RTX_3090": 0.77, "RTX_4090": 1.0, "RTX_5090": 1.43}
FALLBACK_PRICE = {"RTX_3090": 0.15, "RTX_4090": 0.32, "RTX_5090": 0.60}
GPU_MARKET_NAME = {"RTX_3090": "RTX 3090", "RTX_4090": "RTX 4090", "RTX_5090": "RTX 5090"}
GPU_TYPES = ("RTX_3090", "RTX_4090", "RTX_5090")
LOCAL_GPU = "RTX_4090"
DEFAULT_SPEED = 1.0
DEFAULT_PRICE = 0.30

# Offer thresholds and listing limits.
MAX_COST_PER_HOUR = 0.45
MIN_NETWORK_MBPS = 800.0
MIN_RELIABILITY = 0.995
OFFERS_PER_QUERY = 20
DEFAULT_CUDA = "12.4"
UNIT_RETRIES = 2
MIN_VRAM_MIB = 20_000
MAX_TEMP_C = 90
BOOT_TIMEOUT_SECONDS = 300
BUDGET_WARNING_SHARE = 0.8

# Enumerations. The first provider is the marketplace of this deployment; all of
# them can be replaced through the parameters of the operators.
PROVIDERS = ("market", "runpod", "local")
TERMINAL_INSTANCE_STATES = ("destroyed",)
SHARD_TERMINAL = ("downloaded", "destroyed", "failed")
JOB_TERMINAL = ("completed", "downloaded", "failed")
VERDICTS = ("destroyed", "cli_attempted", "already_gone", "leaked", "unknown")
REFUSALS = (
    "ownership",
    "no_credentials",
    "credentials_disabled",
    "ineligible_state",
    "provider_mismatch",
)
SUCCESS_VERDICTS = ("destroyed", "already_gone")
SEVERITY = {
    "leaked": "error",
    "unknown": "warning",
    "cli_attempted": "warning",
    "already_gone": "info",
    "credentials_disabled": "warning",
    "no_credentials": "warning",
    "ownership": "info",
    "ineligible_state": "info",
    "provider_mismatch": "info",
}
SUCCESS_STATUS = (200, 204)
CLEARED_VERIFICATIONS = ("owned", "absent", "disabled")

# State document fields.
SCHEMA_VERSION = 1
SHARD_FIELDS = (
    "shard_id", "instance_id", "provider", "ssh_host", "ssh_port", "cost_per_hour", "status",
    "items_expected", "items_completed", "item_ids", "start_time", "end_time", "failure_reason",
    "retry_count",
)
JOB_FIELDS = (
    "job_name", "status", "instance_id", "ssh_host", "ssh_port", "machine_id", "error",
    "submit_time", "complete_time", "cost_per_hour", "retry_count", "metadata",
)
SHARD_BATCH_FIELDS = (
    "batch_id", "label", "label_scope", "requested_label_prefix", "schema_version", "num_gpus",
    "shards", "created_at", "updated_at", "metadata",
)
JOB_BATCH_FIELDS = (
    "batch_id", "label_scope", "requested_label_prefix", "schema_version", "jobs", "created_at",
    "updated_at", "metadata",
)

# The id family of managed retention rules is this engine's own.
RULE_FAMILY = "fleetlens-"
RULE_ID_PREFIX = "fleetlens-expire-"
