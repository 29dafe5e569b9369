"""All registered queries."""

from . import sourcing  # noqa: F401
from . import scalars, cleaning, windows, checks, evaluation  # noqa: F401
from . import modelling, forecasting, streams  # noqa: F401
from .core import ORACLES, QUERIES  # noqa: F401
