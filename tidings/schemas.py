"""Column names and types shared by every module."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# Field names and types of the campaign message.
CAMPAIGN_SCHEMA = StructType(
    [
        StructField("restaurant_id", StringType()),
        StructField("adv_campaign_id", StringType()),
        StructField("adv_campaign_content", StringType()),
        StructField("adv_campaign_owner", StringType()),
        StructField("adv_campaign_owner_contact", StringType()),
        StructField("adv_campaign_datetime_start", LongType()),
        StructField("adv_campaign_datetime_end", LongType()),
        StructField("datetime_created", LongType()),
    ]
)
CAMPAIGN_COLUMNS = CAMPAIGN_SCHEMA.fieldNames()

FAVOURITE_COLUMNS = ["client_id", "restaurant_id"]

# Column order of a notification, and of its table row.
NOTIFICATION_COLUMNS = [*CAMPAIGN_COLUMNS, "client_id", "trigger_datetime_created"]
FEEDBACK_COLUMNS = [*NOTIFICATION_COLUMNS, "feedback"]
FEEDBACK_SCHEMA = StructType(
    [
        *CAMPAIGN_SCHEMA.fields,
        StructField("client_id", StringType()),
        StructField("trigger_datetime_created", IntegerType()),
        StructField("feedback", StringType()),
    ]
)

# Names one message of the source. Together with client_id it identifies a
# notification, because equal campaign messages may legitimately repeat.
MESSAGE_ID = "message_id"
HEADER_COLUMNS = [MESSAGE_ID, "client_id"]

LETTER_SCHEMA = StructType([StructField(name, StringType()) for name in (MESSAGE_ID, "payload", "missing_fields")])
