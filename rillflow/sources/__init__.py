"""Sources: functions of a Spark session that return DataFrames."""

from rillflow.sources.connectors import *  # noqa: F403
from rillflow.sources.files import *  # noqa: F403
