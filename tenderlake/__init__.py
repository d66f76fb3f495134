"""tenderlake — public-procurement analytics on Spark.

Nested contract registers are landed into a typed table, cleaned and flagged,
linked to economic groups, and turned into analytical tables (group rankings,
buyer profiles, concentration per product code, spending per department,
procedure mix, recurring buyer/supplier pairs, anomalies and overruns).
Everything is expressed with DataFrame operations so Catalyst plans it.
"""

__all__ = ["session"]
