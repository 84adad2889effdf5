"""Operators on records; each takes a DataFrame and returns one."""

from rillflow.operators.aggregate import *  # noqa: F403
from rillflow.operators.base import *  # noqa: F403
from rillflow.operators.control import *  # noqa: F403
from rillflow.operators.edit import *  # noqa: F403
from rillflow.operators.filters import *  # noqa: F403
from rillflow.operators.mapping import *  # noqa: F403
from rillflow.operators.order import *  # noqa: F403
from rillflow.operators.sinks import *  # noqa: F403
