"""Column names and types of the conversation data model.

Operators take column names as parameters; these are the defaults.
"""

from pyspark.sql.types import (ArrayType, StringType, StructField, StructType)

KEY = "conversation_hash"
MODEL = "model"
TS = "ts"
TURN = "turn"
LANG = "language"
COUNTRY = "country"
STATE = "state"
REDACTED = "redacted"
TOXIC = "toxic"
TAGS = "tags"
CONV = "conversation"
CONV_EN = "conversation_en"
TEXT = "text"

MESSAGE = StructType([StructField("role", StringType()),
                      StructField("content", StringType())])
CONVERSATION = ArrayType(MESSAGE)

SLIM_COLUMNS = [KEY, MODEL, TS, TURN, LANG, TOXIC, REDACTED, STATE, COUNTRY, TAGS]
