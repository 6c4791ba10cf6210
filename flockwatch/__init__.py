"""flockwatch: cohort-activity analytics on Spark DataFrames.

Ingest delimited trade records, resolve account keys, flag (day, fund, side)
groups whose share of the day's accounts stands out against the fund's own
trailing window, mine the account sets that recur across flagged groups and
report on them.  Every public function takes and returns DataFrames; planning
and physical strategy are left to Catalyst and adaptive execution.
"""

from flockwatch.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
