"""Fixed values of the order contract. Results depend on them, so they are stated plainly."""

# Accepted order statuses and currency codes, amount bounds.
STATUSES = ["confirmed", "pending_payment", "shipped", "delivered", "cancelled"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "CNY", "INR", "MXN"]
MIN_AMOUNT = "0.01"
MAX_AMOUNT = "999999.99"

# Tax rate per region, rate for an unknown region, region for an unknown customer.
TAX_RATES = {"us": "0.08", "eu": "0.19", "uk": "0.20", "ca": "0.05", "au": "0.10"}
DEFAULT_TAX_RATE = "0.10"
DEFAULT_REGION = "ca"

# Value-category bounds, both inclusive in "medium".
SMALL_BELOW = "50"
LARGE_ABOVE = "500"

# Dead-letter message length in characters, duplicate memory, window and lateness.
DLQ_MESSAGE_CHARS = 10000
DEDUP_TTL_SECONDS = 24 * 3600
ORDER_WINDOW = "5 minutes"
ORDER_WINDOW_SECONDS = 300
LATENESS = "10 minutes"
LATENESS_SECONDS = 600
TICK_WINDOW = "1 minute"

# Known tickers.
TICKERS = ["AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "META", "NVDA", "NFLX", "AMD", "INTC"]

# Dead-letter error classes and their names in logs and metrics.
ERROR_NAMES = {
    "SCHEMA_INVALID": "parse_error",
    "BUSINESS_RULE_VIOLATION": "validation_error",
    "DUPLICATE": "duplicate",
    "TIMEOUT": "timeout",
}
LOG_ERROR_TYPES = ["parse_error", "validation_error", "duplicate", "timeout", "external_api_error"]

# Topic names.
RAW_TOPIC = "ecommerce.orders.raw"
PROCESSED_TOPIC = "ecommerce.orders.processed"
DLQ_TOPIC = "ecommerce.orders.dlq"
AGGREGATIONS_TOPIC = "ecommerce.orders.aggregations"
