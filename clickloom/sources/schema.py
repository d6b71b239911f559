"""Schema of the events table."""

from pyspark.sql import types as T


def _field(name: str, data_type: T.DataType, nullable: bool, comment: str) -> T.StructField:
    return T.StructField(name, data_type, nullable, {"comment": comment})


EVENTS = T.StructType([
    _field("event_time", T.TimestampType(), False, "When the event happened, UTC."),
    _field("event_type", T.StringType(), False, "view, cart or purchase."),
    _field("product_id", T.LongType(), False, "Product the event is about."),
    _field("category_id", T.LongType(), False, "Numeric category of the product."),
    _field("category_code", T.StringType(), True, "Dotted category path; NULL if the product has none."),
    _field("brand", T.StringType(), True, "Brand in lower case; NULL if unknown."),
    _field("price", T.DoubleType(), False, "Price of one unit; 0.0 means unknown."),
    _field("user_id", T.LongType(), False, "Visitor, stable across sessions."),
    _field("user_session", T.StringType(), True, "Session of the visitor; changes after a long pause."),
])

# The text files carry the time as text, e.g. "2019-10-01 00:00:00 UTC".
EVENT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"
CSV_EVENTS = T.StructType(
    [T.StructField("event_time", T.StringType(), True)]
    + [T.StructField(f.name, f.dataType, True) for f in EVENTS.fields[1:]]
)
