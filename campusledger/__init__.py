"""Student-services records analytics, built on Spark DataFrames.

Sub-packages:

* ``sources``   -- table loaders (parquet, fixture views, JDBC, import files,
                   stored-file listings) and the versioned snapshot sink.
* ``functions`` -- column-expression helpers shared by every operator
                   (case-insensitive matching, JSON attachment parsing, date
                   parsing, MySQL-compatible casts).
* ``operators`` -- the analytics: KPIs, monthly trends, per-student summaries,
                   projections, filters and searches, attachment flattening,
                   referrals, inbox, batch changes and bulk import.
* ``plans``     -- the registered query catalog (Spark side and SQL oracle).
"""

from campusledger.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
