"""quillon: ledger analytics and training-data operators on PySpark."""
