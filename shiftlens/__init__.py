"""shiftlens: workforce analytics as Spark jobs.

Every public operator is a function from DataFrames (and plain parameters) to a
DataFrame.  Nothing here starts a job by itself unless its docstring says so.
"""

from shiftlens.session import build_session, use_utc
from shiftlens.settings import Settings

__all__ = ["Settings", "build_session", "use_utc"]
