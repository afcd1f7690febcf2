"""Column -> Column scalar functions (C1-C30). All built from Spark built-ins."""

from ledgerflow.functions.scalars import *  # noqa: F401,F403
