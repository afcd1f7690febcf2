"""ledgerflow: procure-to-pay analytics and raw-vault loading on Spark.

Every operator is a lazy DataFrame -> DataFrame (or Column -> Column)
function built from Spark's own functions; nothing is collected inside an
operator. See README.md for the layout.
"""

__version__ = "0.1.0"
