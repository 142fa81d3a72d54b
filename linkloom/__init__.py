"""linkloom: internal-link analytics as Spark DataFrame plans.

Pages (CSV, Parquet or raw HTML) become a corpus table; topic phrases of every
page are matched against the text of every other page with distributed
equi-joins; the matches are ranked and capped per page under explicit rules;
suggestion tables are audited against those rules; response tables are parsed
into suggestions; run events are folded into job states. Everything is
expressed with DataFrame / SQL built-ins so Catalyst plans it.
"""

from linkloom.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
