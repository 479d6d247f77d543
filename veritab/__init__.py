"""A Spark-native engine for profiling tables and checking them against contracts."""

__version__ = "0.1.0"

from .model import ColumnProfile, Kind, Seen, TableProfile  # noqa: E402
from .operators.profile import Privacy, ProfileOptions, profile  # noqa: E402

__all__ = ["ColumnProfile", "Kind", "Privacy", "ProfileOptions", "Seen", "TableProfile", "profile", "__version__"]
