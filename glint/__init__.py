"""glint: market signals, memory tables and hybrid retrieval as Spark jobs.

Every public operator takes and returns DataFrames; nothing is collected to the
driver and nothing reads the wall clock (times are arguments or columns).
"""

from glint.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
