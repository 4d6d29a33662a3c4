from tidemark.functions.casts import (
    epoch_ms_to_date,
    epoch_ms_to_timestamp,
    parse_date,
    parse_timestamp,
    safe_ratio,
    stable_round,
    to_typed,
    to_whole,
)
from tidemark.functions.trading import (
    implied_price,
    is_buy,
    mid_price,
    place_in_hour,
    quote_midpoint,
    quote_volume,
    settlement_date,
    signed_quantity,
    spread,
)

__all__ = [
    "epoch_ms_to_date",
    "epoch_ms_to_timestamp",
    "implied_price",
    "is_buy",
    "mid_price",
    "parse_date",
    "parse_timestamp",
    "place_in_hour",
    "quote_midpoint",
    "quote_volume",
    "safe_ratio",
    "settlement_date",
    "signed_quantity",
    "spread",
    "stable_round",
    "to_typed",
    "to_whole",
]
