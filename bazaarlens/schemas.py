"""Schemas, keys and value domains of the nine marketplace tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "money": MONEY,
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    """``name type [not null]`` items; written out so that no session is needed on import."""
    fields = []
    for item in columns.split(","):
        name, kind, *required = item.split()
        fields.append(T.StructField(name, _TYPES[kind], not required))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        "customer_id string, unique_customer_id string, customer_zip_code_prefix string, "
        "customer_city string, customer_state string"
    ),
    "orders": _struct(
        "order_id string, customer_id string, order_status string, "
        "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
        "order_estimated_delivery_date timestamp_ntz"
    ),
    "order_items": _struct(
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "shipping_limit_date timestamp_ntz, price money, freight_value money"
    ),
    "order_payments": _struct(
        "order_id string, payment_sequential int, payment_type string, "
        "payment_installments int, payment_value money"
    ),
    "reviews": _struct(
        "review_id string not null, order_id string not null, review_score int not null, "
        "review_comment_title string, review_comment_message string, "
        "review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz"
    ),
    "products": _struct(
        "product_id string, product_category_name string, product_weight_g money, "
        "product_length_cm money, product_height_cm money, product_width_cm money"
    ),
    "sellers": _struct(
        "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string"
    ),
    "product_category_name_translation": _struct(
        "product_category_name string, product_category_name_english string"
    ),
    "geolocation": _struct(
        "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, "
        "geolocation_state string"
    ),
}

# The column group that should identify a row. Geolocation has none.
KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "reviews": ("review_id", "order_id"),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "product_category_name_translation": ("product_category_name",),
}

# Longest text that a fixed-width column takes.
TEXT_LIMITS: dict[str, dict[str, int]] = {"reviews": {"review_id": 32, "order_id": 32}}

# Tables with free text, whose CSV fields may hold line breaks.
FREE_TEXT_TABLES = frozenset({"reviews"})

# The 27 federative-unit codes.
STATE_CODES = (
    "AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA",
    "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO",
)

# Order states, payment kinds, score and installment limits.
ORDER_STATUSES = (
    "delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created", "approved",
)
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
SCORE_RANGE = (1, 5)
INSTALLMENT_RANGE = (1, 24)

# Patterns a field's text must match.
DIGITS = "^[0-9]+$"
PLAIN_NUMBER = r"^[0-9]+(\.[0-9]+)?$"
ISO_DATE_START = r"^\d{4}-\d{2}-\d{2}"


@dataclass(frozen=True)
class Box:
    """A closed latitude/longitude rectangle."""

    lat_min: float
    lat_max: float
    lng_min: float
    lng_max: float


# The accepted coordinate rectangle.
COUNTRY_BOX = Box(lat_min=-34, lat_max=6, lng_min=-75, lng_max=-33)
