"""Column functions over raw text, dates and distributions."""

from pairloom.functions.parsing import *  # noqa: F403
from pairloom.functions.stats import *  # noqa: F403
