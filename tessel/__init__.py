"""tessel: Spark-native table operators and the composed analytics jobs built from them.

Every operator is a plain function ``DataFrame -> DataFrame`` written with built-in
Spark expressions, so Catalyst plans it and it runs unchanged on a cluster.
Chain operators with ``df.transform(op, ...)``.
"""

from tessel.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
